"""Bookkeeping of training runs: conditions from run names, missing runs, best runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Model markers in run names, in order of precedence, with the tokenizer they imply.
MODEL_MARKERS = [
    ("albert-base-v2", "albert-base-v2"),
    ("bert-base-cased", "bert-base-cased"),
    ("flaubert_base_cased", "flaubert/flaubert_base_cased"),
    ("bert-base-dutch-cased", "GroNLP/bert-base-dutch-cased"),
    ("bert-base-uncased", "bert-base-uncased"),
    ("deberta-base", "microsoft/deberta-base"),
]
# Models whose embeddings are re-initialised only on request; all others always are.
OPTIONAL_REINIT = ["bert-base-uncased", "microsoft/deberta-base"]
# Language shifts in run names.
SHIFTS = ["en~fr@N~fr@V", "en~jaktc@N~jaktc@V", "en~fr@N~jaktc@V"]
# Learning rates in run names.
LEARNING_RATES = [("lr_4e-05", 4e-05), ("lr_2e-05", 2e-05), ("lr_6e-05", 6e-05), ("lr_8e-05", 8e-05)]


def _first_marker(name: Column, choices: list[tuple[str, object]], default: Column) -> Column:
    out = None
    for marker, value in choices:
        out = F.when(name.contains(marker), F.lit(value)) if out is None else out.when(name.contains(marker), F.lit(value))
    return out.otherwise(default)


def _after(name: Column, word: str) -> Column:
    """Part of an underscore-separated name that follows the last occurrence of ``word``."""
    hit = F.regexp_extract(name, rf"^(?:.*_)?{word}_([^_]*)", 1)
    return F.when(hit != "", hit)


def parse_run_names(df: DataFrame, col: str) -> DataFrame:
    """Condition columns of a run from its name.

    The perturbed type is what follows the second dash of the last data section that has one, else empty.
    """
    name = F.col(col)
    tokenizer = _first_marker(name, MODEL_MARKERS, F.lit(None).cast("string"))
    reinit = F.when(tokenizer.isNull(), F.lit(None)).when(
        tokenizer.isin(OPTIONAL_REINIT), name.contains("reinit_emb_True")
    ).otherwise(F.lit(True))
    mid = F.when(name.contains("inoculation_1.0"), True).when(name.contains("inoculation_0.0"), False)
    shift = _first_marker(name, [(f"data_wikitext-15M-{s}", s) for s in SHIFTS], F.lit("null"))
    first_task = F.regexp_extract(name, r"(?:^|_)task_([^_]*)", 1)
    return df.withColumns(
        {
            "task": F.when(first_task != "", first_task),
            "model": tokenizer,
            "learning_rate": _first_marker(name, LEARNING_RATES, F.lit(2e-05)),
            "seed": _after(name, "seed").cast("int"),
            "inoculation": F.coalesce(_after(name, "inoculation").cast("double"), F.lit(0.0)),
            "midtuning": mid,
            "galactic_shift": shift,
            "perturbed_type": F.regexp_extract(name, r"^(?:.*_)?data_[^_-]*-[^_-]*-([^_]*)", 1),
            "reinit_embedding": reinit,
            "reverse_order": name.contains("reverse_True"),
            "random_order": name.contains("random_True"),
            "token_swap": name.contains("token_s_True"),
            "word_swap": name.contains("word_s_True"),
            "word_swap_frequency": name.contains("word_freq_s_True"),
        }
    )


def _drop_parts(name: Column, n: int) -> Column:
    parts = F.split(name, "_")
    return F.array_join(F.slice(parts, F.lit(n + 1), F.greatest(F.size(parts) - n, F.lit(0))), "_")


def missing_runs(expected: DataFrame, path: str, done: DataFrame, name: str) -> DataFrame:
    """Expected records without a finished run, one row each, with the (alphabetically last) folder.

    The record of a folder is its last path part without the first underscore part; that of a finished
    run is its name without the first four.
    """
    folder = F.element_at(F.split(F.trim(F.col(path), F.lit("/")), "/"), -1)
    wanted = expected.select(F.col(path).alias("path"), _drop_parts(folder, 1).alias("record"))
    finished = done.select(_drop_parts(F.col(name), 4).alias("record")).distinct()
    folders = wanted.groupBy("record").agg(F.max("path").alias("path"))
    return folders.join(finished, "record", "left_anti").select("record", "path")


def best_runs(df: DataFrame, keys: list[str], score: str, run: str) -> DataFrame:
    """Best score of every task and condition, and the run that reached it (ties: by hash of the name)."""
    best = F.max_by(F.col(run), F.struct(F.col(score), F.col("_tie")))
    return (
        df.withColumn("_tie", F.md5(run))
        .groupBy(*keys)
        .agg(F.max(score).alias("best_score"), best.alias("best_run"))
    )
