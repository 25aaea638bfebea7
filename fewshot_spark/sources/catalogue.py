"""Label catalogue: dataset -> template, label names (position = label id), metric.

The catalogue is a small dimension table; joins against it are broadcast because its size is
fixed by this file (a few hundred rows), not by the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------
# Fixed values. Templates (kept verbatim, double blanks included), label names in label-id
# order, and metric names of the evaluated text sets. They must stay exactly as written for the
# anchors and result records to equal those of the original experiments.
# ---------------------------------------------------------------------------------------------

TEMPLATES = {
    "sst5": "The movie is  ",
    "CR": "The movie is  ",
    "emotion": "The emotion is ",
    "ag_news": "The topic is about ",
    "yelp_review_full": "The experience was ",
    "yahoo_answers_topics": "The question is about ",
}

LABELS = {
    "sst5": ["terrible", "bad", "okay", "good", "great"],
    "emotion": ["sadness", "joy", "love", "anger", "fear", "surprise"],
    "CR": ["bad", "good"],
    "ag_news": ["World", "Sports", "Business", "Sci/Tech"],
    "yelp_review_full": ["terrible", "bad", "okay", "good", "great"],
    "yahoo_answers_topics": [
        "Society & Culture", "Science & Mathematics", "Health", "Education & Reference",
        "Computers & Internet", "Sports", "Business & Finance", "Entertainment & Music",
        "Family & Relationships", "Politics & Government",
    ],
}

DATASET_TO_METRIC = {
    "sst5": "accuracy",
    "emotion": "accuracy",
    "CR": "accuracy",
    "ag_news": "accuracy",
    "yelp_review_full": "accuracy",
    "yahoo_answers_topics": "accuracy",
}

DEV_DATASET_TO_METRIC = {
    "sst2": "accuracy",
    "imdb": "accuracy",
    "bbc-news": "accuracy",
    "student-question-categories": "accuracy",
    "TREC-QC": "accuracy",
    "toxic_conversations": "matthews_correlation",
}

DEV_TEMPLATES = {
    "sst2": "The movie review is  ",
    "imdb": "The movie review is ",
    "bbc-news": "The topic is about ",
    "student-question-categories": "The subject is ",
    "TREC-QC": "The question is regarding ",
    "toxic_conversations": "The tone in the conversation was ",
}

DEV_LABELS = {
    "sst2": ["negative", "positive"],
    "imdb": ["negative", "positive"],
    "toxic_conversations": ["fine", "toxic"],
    "bbc-news": ["tech", "business", "sport", "entertainment", "politics"],
    "student-question-categories": ["Biology", "Chemistry", "Maths", "Physics"],
    "TREC-QC": [
        "manner of an action", "inventions, books and other creative pieces", "animals",
        "expression abbreviated", "an individual", "a group or organization of persons",
        "title of a person", "definition of something", "dates", "reasons", "events", "states",
        "description of something", "number of something", "other entities", "letters like a-z",
        "other locations", "religions", "food", "countries", "colors", "equivalent terms", "cities",
        "organs of body", "diseases and medicine", "mountains", "prices", "products",
        "the lasting time of something", "elements and substances", "sports", "plants",
        "techniques and methods", "size, area and volume", "description of a person",
        "musical instrument", "abbreviation", "other numbers", "speed",
        "words with a special property", "languages", "fractions", "postcodes or other codes",
        "linear measures", "temperature", "symbols and signs", "ranks", "vehicles", "weight",
        "currency names",
    ],
}

MULTI_TEMPLATE = {
    "go_emotions": "The emotions are ",
    "abstract": "The paper is in the field of ",
    "semeval2018task1": "The emotions are ",
}

MULTI_LABELS = {
    "go_emotions": [
        "admiration", "amusement", "anger", "annoyance", "approval", "caring", "confusion",
        "curiosity", "desire", "disappointment", "disapproval", "disgust", "embarrassment",
        "excitement", "fear", "gratitude", "grief", "joy", "love", "nervousness", "optimism",
        "pride", "realization", "relief", "remorse", "sadness", "surprise", "neutral",
    ],
    "abstract": [
        "Computer Science", "Physics", "Mathematics", "Statistics", "Quantitative Biology",
        "Quantitative Finance",
    ],
    "semeval2018task1": [
        "anger", "anticipation", "disgust", "fear", "joy", "love", "optimism", "pessimism",
        "sadness", "surprise", "trust",
    ],
}

# Label-name ablation tables (the four ablation sets use DEV_TEMPLATES / DEV_LABELS as default).
ABLATION_SETS = ["sst2", "imdb", "bbc-news", "student-question-categories"]

DEV_TEMPLATES_A = {
    "sst2": "The movie is ",
    "imdb": "The movie is ",
}

DEV_TEMPLATES_Q = {
    "sst2": "What is the movie review?  ",
    "imdb": "What is the movie review? ",
    "bbc-news": "What is topic in the news about? ",
    "student-question-categories": "What is the topic in the question about?  ",
}

DEV_LABELS_A = {
    "sst2": ["bad", "good"],
    "imdb": ["bad", "good"],
}

# Column renames the abstract set needs so its label columns carry no blank.
ABSTRACT_RENAMES = {
    "Computer Science": "ComputerScience",
    "Quantitative Biology": "QuantitativeBiology",
    "Quantitative Finance": "QuantitativeFinance",
}

# ---------------------------------------------------------------------------------------------
# Our own entries for the driver tables (documents ⋈ labels, embeddings). Not fixed values of the
# experiments; they give the driver data a template, names and a metric like any other set.
# ---------------------------------------------------------------------------------------------
DRIVER_SETS = {
    # dataset: (template, names, metric, multi-label)
    "documents_quality": ("The text quality is ", ["low", "high"], "accuracy", False),
    "documents_toxic": ("The tone of the text is ", ["fine", "toxic"], "matthews_correlation", False),
    "documents_lang": ("The language is ", ["German", "English", "Spanish", "French"], "accuracy", False),
    "documents_flags": ("The text is ", ["high quality", "toxic"], "f1", True),
    "documents_flags6": (
        "The text is ", ["English", "German", "Spanish", "French", "high quality", "toxic"], "f1", True,
    ),
    "embeddings": ("The topic is about ", [f"topic {i}" for i in range(10)], "accuracy", False),
}
# documents.lang values in label-id order for documents_lang, and the six flags of documents_flags6.
LANG_CODES = ["de", "en", "es", "fr"]
FLAGS6 = ["en", "de", "es", "fr", "quality", "toxic"]

CATALOGUE_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType(), False),
        T.StructField("variant", T.StringType(), False),
        T.StructField("group", T.StringType(), False),
        T.StructField("label_id", T.IntegerType(), False),
        T.StructField("label_name", T.StringType(), False),
        T.StructField("template", T.StringType(), False),
        T.StructField("metric", T.StringType(), False),
    ]
)


@dataclass(frozen=True)
class DatasetSpec:
    dataset: str
    group: str
    template: str
    labels: tuple[str, ...]
    metric: str
    multilabel: bool = False


def dataset_specs() -> list[DatasetSpec]:
    """All sets in catalogue order: test, dev, multi, driver."""
    out = [DatasetSpec(d, "test", TEMPLATES[d], tuple(LABELS[d]), DATASET_TO_METRIC[d]) for d in DATASET_TO_METRIC]
    out += [DatasetSpec(d, "dev", DEV_TEMPLATES[d], tuple(DEV_LABELS[d]), DEV_DATASET_TO_METRIC[d]) for d in DEV_DATASET_TO_METRIC]
    out += [DatasetSpec(d, "multi", MULTI_TEMPLATE[d], tuple(MULTI_LABELS[d]), "f1", True) for d in MULTI_TEMPLATE]
    out += [DatasetSpec(d, "driver", t, tuple(n), m, ml) for d, (t, n, m, ml) in DRIVER_SETS.items()]
    return out


def spec(dataset: str) -> DatasetSpec:
    for s in dataset_specs():
        if s.dataset == dataset:
            return s
    raise KeyError(f"dataset {dataset!r} is not in the catalogue")


def variant_rows() -> list[tuple]:
    """Stored ablation variants (PEM and ALF are derived by rule in ``operators.variants``)."""
    rows = []
    for d in ABLATION_SETS:
        names = DEV_LABELS[d]
        metric = DEV_DATASET_TO_METRIC[d]
        rows += [(d, "SHORT", "dev", i, n, "", metric) for i, n in enumerate(names)]
        rows += [(d, "QA", "dev", i, n, DEV_TEMPLATES_Q[d], metric) for i, n in enumerate(names)]
        if d in DEV_LABELS_A:
            rows += [(d, "A", "dev", i, n, DEV_TEMPLATES_A[d], metric) for i, n in enumerate(DEV_LABELS_A[d])]
    return rows


def catalogue_rows() -> list[tuple]:
    rows = []
    for s in dataset_specs():
        rows += [(s.dataset, "default", s.group, i, n, s.template, s.metric) for i, n in enumerate(s.labels)]
    return rows + variant_rows()


def label_catalogue(spark: SparkSession) -> DataFrame:
    """The catalogue as a DataFrame ``(dataset, variant, group, label_id, label_name, template, metric)``."""
    return spark.createDataFrame(catalogue_rows(), CATALOGUE_SCHEMA)


def catalogue_values_sql(variant: str | None = "default") -> str:
    """DuckDB ``(VALUES ...)`` text of the catalogue, for oracle queries."""

    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    rows = [r for r in catalogue_rows() if variant is None or r[1] == variant]
    body = ",\n".join(
        f"({q(d)}, {q(v)}, {q(g)}, {i}, {q(n)}, {q(t)}, {q(m)})" for d, v, g, i, n, t, m in rows
    )
    return (
        f"(SELECT * FROM (VALUES {body}) AS c(dataset, variant, \"group\", label_id, label_name, template, metric))"
    )


def resolve_datasets(
    spark: SparkSession,
    names: list[str] | None = None,
    group: str | None = None,
    *,
    is_dev_set: bool = False,
    is_test_set: bool = False,
) -> DataFrame:
    """Datasets to run with their metric: ``(dataset, group, metric, n_labels)``.

    The dev flag wins over the test flag; a dev request with names keeps the named dev sets; a
    test request takes all test sets; otherwise the named sets (any group) or the named ``group``.
    An unknown name raises, naming it.
    """
    specs = dataset_specs()
    if is_dev_set:
        pool = [s for s in specs if s.group == "dev"]
        chosen = [s for s in pool if not names or s.dataset in names]
        wanted = names or []
    elif is_test_set:
        chosen = [s for s in specs if s.group == "test"]
        wanted = []
    elif names:
        pool = specs if group is None else [s for s in specs if s.group == group]
        chosen = [s for s in pool if s.dataset in names]
        wanted = names
    elif group:
        chosen = [s for s in specs if s.group == group]
        wanted = []
    else:
        raise ValueError("name datasets, a group, or set is_dev_set / is_test_set")
    missing = sorted(set(wanted) - {s.dataset for s in chosen})
    if missing:
        raise KeyError(f"unknown dataset(s) {missing}")
    schema = "dataset string, group string, metric string, n_labels int"
    return spark.createDataFrame([(s.dataset, s.group, s.metric, len(s.labels)) for s in chosen], schema)
