"""Score a stream of texts with trained split weights.

The original experiments have no stream; this applies the same two stateless operators (the
hashed encoder and ``predict``) to a ``readStream`` source, so new texts get the predictions a
batch run would give them. Both are per-row maps over Arrow batches, so the streaming plan has no
state and no shuffle; the weights (a bounded, size-checked table) are broadcast once per query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.encode import encode_hash
from ..operators.heads import predict


def score_texts(texts: DataFrame, weights: DataFrame, keys: list[str], id_col: str = "row_id", text_col: str = "text",
                dim: int = 256, names: list[str] | None = None) -> DataFrame:
    """Predictions ``(keys, row_id, y_pred[, y_name])`` for a batch or streaming text table."""
    enc = encode_hash(texts.select(id_col, text_col), id_col, text_col, dim=dim)
    out = predict(enc, weights, keys, id_col=id_col, label_col=None).drop("y_true")
    if names:
        m = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(n))])
        out = out.withColumn("y_name", F.try_element_at(m, F.col("y_pred")))
    return out


def start_scoring(stream: DataFrame, weights: DataFrame, keys: list[str], sink_path: str, checkpoint: str | None = None,
                  id_col: str = "row_id", text_col: str = "text", dim: int = 256, names: list[str] | None = None,
                  trigger_once: bool = False):
    """Start a query appending predictions as Parquet to ``sink_path``; the stream checkpoint lies
    beside the sink unless given, so a restarted application finds it and scores nothing twice."""
    scored = score_texts(stream, weights, keys, id_col, text_col, dim, names)
    ckpt = checkpoint or f"{sink_path.rstrip('/')}-checkpoint"
    writer = scored.writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", ckpt).outputMode("append")
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
