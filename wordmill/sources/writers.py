"""Writers of datasets, vocabularies, maps, results and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmill.functions import fixed
from wordmill.functions.hashing import hash_key
from wordmill.sources.readers import SPLIT_FILES

WRITE_OPTIONS = {
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_tsv(*datasets: DataFrame, path: str, cols: list[str], seed: int = 42) -> None:
    """Chosen columns of all datasets in seeded random order, tab-separated with a header."""
    table = datasets[0].select(*cols)
    for other in datasets[1:]:
        table = table.unionByName(other.select(*cols))
    flat = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
        for f in table.schema.fields
    ]
    table.select(*flat).orderBy(hash_key(seed, *cols)).write.csv(path, sep="\t", header=True, **WRITE_OPTIONS)


def write_splits(df: DataFrame, folder: str, cols: list[str], split: str = "split", seed: int = 42) -> None:
    """One TSV per split, with the file names that the split reader expects."""
    for name, file in SPLIT_FILES.items():
        write_tsv(df.where(F.col(split) == name), path=f"{folder}/{file}", cols=cols, seed=seed)


def save_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """Columnar dataset with one folder per split."""
    df.write.partitionBy(split).parquet(path)


def save_map(df: DataFrame, path: str) -> None:
    """Vocabulary, frequency table or substitution map for later use."""
    df.write.parquet(path)


def write_vocab(vocab: DataFrame, path: str) -> bool:
    """Tokens in id order, one per line; returns whether the ids are consecutive from 0."""
    vocab.orderBy("id").select("token").write.text(path)
    low, high, n = vocab.agg(F.min("id"), F.max("id"), F.countDistinct("id")).first()
    return n == 0 or (low == 0 and high == n - 1)


def append_results(df: DataFrame, path: str) -> None:
    """Add evaluation rows to the results table; the columns must be the agreed ones."""
    if set(df.columns) != set(fixed.RESULT_COLUMNS):
        raise ValueError(f"result rows need the columns {fixed.RESULT_COLUMNS}")
    df.select(*fixed.RESULT_COLUMNS).write.mode("append").option("header", True).csv(path)


def export_predictions(df: DataFrame, path: str, names: dict[int, str] | None, index: str = "index", pred: str = "pred") -> None:
    """Index and label name in index order; without names the prediction is a number with 3 decimals."""
    if names is None:
        value = F.format_string("%.3f", F.col(pred).cast("double"))
    else:
        table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        value = F.element_at(table, F.col(pred))
    out = df.select(F.col(index).alias("index"), value.alias("prediction"))
    out.orderBy("index").write.csv(path, sep="\t", header=True, **WRITE_OPTIONS)
