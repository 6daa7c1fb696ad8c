"""Stored bars, label sets and weight sets: partitioned Parquet plus small catalog tables.

Layout below one root: ``bars``, ``labels`` and ``weights`` are partitioned by series, threshold and
recipe, so a lookup reads its own folders only; ``label_catalog`` and ``weight_catalog`` hold one
row per stored set and are all that listing reads.
"""

from __future__ import annotations

from dataclasses import asdict, fields
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.functions.configs import LabelConfig, WeightConfig
from tickframe.functions.exprs import symbol_key, threshold_key
from tickframe.operators.bars import bars_to_float
from tickframe.schema import BARS
from tickframe.session import materialize

_THRESHOLD = "decimal(38,8)"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _keyed(df: DataFrame, threshold) -> DataFrame:
    exact = F.lit(str(threshold)).cast(_THRESHOLD)
    return df.withColumns({"symbol_key": symbol_key(), "thr": threshold_key(exact)})


def _write(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _of_series(df: DataFrame, symbol: str, threshold) -> DataFrame:
    return df.filter((F.col("symbol_key") == symbol_key(F.lit(symbol)))
                     & (F.col("thr") == threshold_key(F.lit(str(threshold)).cast(_THRESHOLD))))


def store_bars(bars: DataFrame, threshold, root: str) -> None:
    """Replace the stored bars of the symbols present."""
    _write(_keyed(bars_to_float(bars), threshold), f"{root}/bars", ["symbol_key", "thr"])


def load_bars(spark: SparkSession, root: str, symbol: str, threshold) -> DataFrame:
    """The bars of one series; a typed empty frame where nothing is stored."""
    if not _exists(spark, f"{root}/bars"):
        return spark.createDataFrame([], BARS)
    return _of_series(spark.read.parquet(f"{root}/bars"), symbol, threshold).select(*BARS.fieldNames())


def last_trade_time(bars: DataFrame) -> DataFrame:
    """Per symbol the resume point: the last trade in any stored bar and the instant after it (+1 ms)."""
    last = F.max("bar_end_ts")
    return bars.groupBy("symbol").agg(
        last.alias("last_trade_ts"), F.timestamp_micros(F.unix_micros(last) + 1000).alias("resume_at"))


def trades_to_resume(trades: DataFrame, bars: DataFrame, since=None) -> DataFrame:
    """Trades from each symbol's resume point on, or from ``since`` where it is given."""
    if since is not None:
        return trades.filter(F.col("ts") >= F.lit(since))
    points = last_trade_time(bars).select("symbol", "resume_at")
    return trades.join(points, "symbol", "left").filter(
        F.col("resume_at").isNull() | (F.col("ts") >= F.col("resume_at"))).drop("resume_at")


def _catalog_rows(stored: DataFrame, threshold, identity: dict, recipe: dict, count: str) -> DataFrame:
    now = datetime.now(timezone.utc).isoformat()
    return stored.groupBy("symbol").agg(F.count("*").alias(count)).withColumns({
        "threshold": F.lit(str(threshold)).cast(_THRESHOLD),
        "thr": threshold_key(F.lit(str(threshold)).cast(_THRESHOLD)),
        "symbol_key": symbol_key(),
        **{name: F.lit(value) for name, value in {**identity, **recipe}.items()},
        "t1_encoding": F.lit("timestamp"),
        "created_at": F.lit(now),
    })


def _catalog(spark: SparkSession, path: str, key: list[str], count: str) -> DataFrame | None:
    """The newest row of every stored set; a set whose newest row counts 0 was removed."""
    if not _exists(spark, path):
        return None
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in key]
    newest = F.max_by(F.struct(*rest), "created_at").alias("_r")
    return rows.groupBy(*key).agg(newest).select(*key, "_r.*").filter(F.col(count) > 0)


def _store(df: DataFrame, threshold, root: str, kind: str, identity: dict, recipe: dict, count: str,
           overwrite: bool, covered: DataFrame | None) -> None:
    spark = df.sparkSession
    key = ["symbol_key", "thr", *identity]
    ready = materialize(df)
    rows = materialize(_catalog_rows(ready, threshold, identity, recipe, count))
    known = _catalog(spark, f"{root}/{kind}_catalog", key, count)
    if known is not None:
        # One row per symbol and recipe on both sides.
        other = known.select("symbol_key", "thr", F.col("threshold").alias("_t"))
        clash = rows.join(other, ["symbol_key", "thr"]).filter(F.col("_t") != F.col("threshold"))
        if not clash.isEmpty():
            raise ValueError(f"threshold {threshold} shares its key with another stored threshold")
        if not overwrite and not rows.join(known, key, "left_semi").isEmpty():
            raise KeyError(f"{kind} set {identity} is already stored and overwrite=False")
    keyed = _keyed(ready, threshold).withColumns({n: F.lit(v) for n, v in identity.items()})
    _write(keyed, f"{root}/{kind}s", key)
    if covered is not None and known is not None:
        # What was stored before for a symbol that now has no rows is no longer a set.
        gone = known.join(covered.select(symbol_key().alias("symbol_key")).distinct(), "symbol_key", "left_semi").filter(
            (F.col("threshold") == F.lit(str(threshold)).cast(_THRESHOLD))).join(rows.select("symbol_key"), "symbol_key", "left_anti")
        for name, value in identity.items():
            gone = gone.filter(F.col(name) == value)
        now = datetime.now(timezone.utc).isoformat()
        rows = materialize(rows.unionByName(gone.withColumns({
            count: F.lit(0).cast("long"), "created_at": F.lit(now)}).select(*rows.columns)))
    rows.write.mode("append").parquet(f"{root}/{kind}_catalog")


def _load(spark: SparkSession, root: str, kind: str, identity: dict, symbol: str, threshold) -> DataFrame:
    if not _exists(spark, f"{root}/{kind}_catalog"):
        raise FileNotFoundError(f"no stored {kind} sets below {root}")
    key = ["symbol_key", "thr", *identity]
    chosen = [F.col(n) == v for n, v in identity.items()]

    def narrow(df: DataFrame) -> DataFrame:
        df = _of_series(df, symbol, threshold)
        for condition in chosen:
            df = df.filter(condition)
        return df

    exact = F.col("threshold") == F.lit(str(threshold)).cast(_THRESHOLD)
    if narrow(_catalog(spark, f"{root}/{kind}_catalog", key, f"n_{kind}s")).filter(exact).isEmpty():
        raise KeyError(f"no {kind} set {identity} stored for {symbol!r} at threshold {threshold}")
    return narrow(spark.read.parquet(f"{root}/{kind}s")).drop(*key)


def _label_identity(config: LabelConfig) -> dict:
    return {"label_hash": config.config_hash()}


def _weight_identity(config: WeightConfig, labels: LabelConfig) -> dict:
    return {"label_hash": labels.config_hash(), "weight_hash": config.config_hash()}


def store_labels(labels: DataFrame, config: LabelConfig, threshold, root: str, overwrite: bool = True,
                 covered: DataFrame | None = None) -> None:
    """Store the label sets of all symbols in the frame; KeyError on an existing one without overwrite. ``covered``, a frame
    with a symbol column, names what was labelled: a symbol in it that has no label loses the set stored before."""
    _store(labels, threshold, root, "label", _label_identity(config), asdict(config), "n_labels", overwrite, covered)


def load_labels(spark: SparkSession, config: LabelConfig, symbol: str, threshold, root: str) -> DataFrame:
    """One label set; FileNotFoundError without a store, KeyError when this recipe was never stored."""
    return _load(spark, root, "label", _label_identity(config), symbol, threshold)


def store_weights(weights: DataFrame, config: WeightConfig, labels: LabelConfig, threshold, root: str,
                  overwrite: bool = True, covered: DataFrame | None = None) -> None:
    """Store weight sets under the label recipe they derive from; ``covered`` as for labels."""
    recipe = {**asdict(config), **{f"label_{k}": v for k, v in asdict(labels).items()}}
    _store(weights, threshold, root, "weight", _weight_identity(config, labels), recipe, "n_weights", overwrite, covered)


def load_weights(spark: SparkSession, config: WeightConfig, labels: LabelConfig, symbol: str, threshold,
                 root: str) -> DataFrame:
    return _load(spark, root, "weight", _weight_identity(config, labels), symbol, threshold)


_KINDS = {int: "long", float: "double", "int": "long", "float": "double"}


def _list(spark: SparkSession, root: str, kind: str, identity: list[str], recipe, count: str) -> DataFrame:
    columns = ["symbol", "threshold", *identity, *(f.name for f in fields(recipe)), count]
    rows = _catalog(spark, f"{root}/{kind}_catalog", ["symbol_key", "thr", *identity], count)
    if rows is not None:
        return rows.select(*columns)
    kinds = [f"{f.name} {_KINDS[f.type]}" for f in fields(recipe)]
    text = ", ".join(["symbol string", f"threshold {_THRESHOLD}", *(f"{n} string" for n in identity), *kinds,
                      f"{count} long"])
    return spark.createDataFrame([], text)


def list_label_configs(spark: SparkSession, root: str) -> DataFrame:
    """One row per stored label set, from the catalog table only."""
    return _list(spark, root, "label", ["label_hash"], LabelConfig, "n_labels")


def list_weight_configs(spark: SparkSession, root: str) -> DataFrame:
    """One row per stored (label recipe, weight recipe), from the catalog table only."""
    return _list(spark, root, "weight", ["label_hash", "weight_hash"], WeightConfig, "n_weights")


def collides(first: Decimal, second: Decimal) -> bool:
    """True when two different thresholds have the same truncated key."""
    return first != second and int(first) == int(second)
