"""The driver tables seen as a phrase library, in Spark and in DuckDB SQL with the same names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_COLUMNS = """p_partkey as key, p_brand as species, p_type as modality, p_retailprice as f0, p_size * 10e0 as duration_ms, p_retailprice / 10e0 as f0_range,
  (p_partkey % 31) * 1e0 as hnr, (p_partkey % 101) / 100e0 as flatness, (p_partkey % 37) * 1e0 as attack, (p_partkey % 23) / 100e0 as jitter,
  (p_partkey % 19) * 1e0 as onset_rate, (p_partkey % 7) / 10e0 as icv, (p_partkey % 3) * 1e0 as ici, p_size as occurrences, p_name as name"""

PHRASES = f"phrases as (select {_COLUMNS} from part)"
#: Contexts of a phrase: the words of its name, the n-th with confidence 1 / n.
CONTEXTS = "contexts as (select key, species, w as name, i, round(1e0 / i, 6) as confidence from (select key, species, unnest(string_split(name, ' ')) as w, generate_subscripts(string_split(name, ' '), 1) as i from phrases))"


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.selectExpr(*[x.strip() for x in _split(_COLUMNS)], "transform(split(p_name, ' '), (w, i) -> named_struct('name', w, 'n', i + 1, 'confidence', round(1e0 / (i + 1), 6))) as contexts")


def _split(columns: str) -> list[str]:
    return columns.replace("\n", " ").split(", ")
