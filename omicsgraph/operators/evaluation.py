"""Labels, splits and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import number_rows


def match_labels(samples: DataFrame, labels: DataFrame, strict: bool = True) -> DataFrame:
    """Samples with their labels; an error if none match (checked with one row)."""
    out = samples.join(labels, "sample_id")
    if strict and out.isEmpty():
        raise ValueError("no sample has a label")
    return out


def train_val_split(samples: DataFrame, ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """(sample_id, part): the first floor(n * ratio) samples in order of md5(sample_id:seed) are for training."""
    ids = samples.select("sample_id").distinct().withColumn("__key", F.md5(F.concat(F.col("sample_id").cast("string"), F.lit(f":{seed}"))))
    numbered = number_rows(ids, [], [F.col("__key"), F.col("sample_id")], "__n")
    n = numbered.agg(F.floor(F.count("*") * F.lit(ratio)).alias("__train"))
    return numbered.crossJoin(F.broadcast(n)).select("sample_id", F.when(F.col("__n") <= F.col("__train"), "train").otherwise("val").alias("part"))  # n is a row


def regression_metrics(pred: DataFrame) -> DataFrame:
    """One row mse, r, r2 of (y_true, y_pred); r2 is null for one row."""
    t, p = F.col("y_true"), F.col("y_pred")
    stats = pred.agg(F.avg((t - p) * (t - p)).alias("mse"), F.covar_pop("y_true", "y_pred").alias("c"), F.var_pop("y_true").alias("vt"), F.var_pop("y_pred").alias("vp"), F.count("*").alias("n"), F.var_samp("y_true").alias("vs"))
    n = F.col("n")
    r = n * F.col("c") / (F.sqrt(n * F.col("vt")) * F.sqrt(n * F.col("vp")) + 1e-8)
    return stats.select("mse", r.alias("r"), (1 - F.col("mse") / (F.when(n > 1, F.col("vs")) + 1e-8)).alias("r2"))


def epoch_log(batches: DataFrame) -> DataFrame:
    """(epoch, train_mse): batch losses weighed by batch size; rows (epoch, loss, bs)."""
    return batches.groupBy("epoch").agg((F.sum(F.col("loss") * F.col("bs")) / F.greatest(F.lit(1), F.sum("bs"))).alias("train_mse"))


def best_epoch(log: DataFrame) -> DataFrame:
    """One row epoch, val_mse: the first epoch with the lowest validation error; NaN never wins."""
    return log.where(~F.isnan("val_mse")).agg(F.min(F.struct("val_mse", "epoch")).alias("b")).select("b.epoch", "b.val_mse")
