"""Fine-tuning data: conversations from validated examples, the plan of steps, truncation."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, fields
from math import ceil
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.text import words
from ..operators import validation as va

#: Fixed value: more than this share over the length limit is refused.
TRUNCATED = 0.10


@dataclass(frozen=True)
class TuningConfig:
    """Settings of a tuning run; relative paths are those of the config file's folder."""

    base_model: str
    train_file: str
    output_dir: str
    eval_file: str | None = None
    revision: str | None = None
    quantize: str = "4bit"
    lora_r: int = 16
    lora_alpha: int = 32
    num_epochs: int = 3
    batch_size: int = 1
    gradient_accumulation: int = 16
    max_seq_len: int = 2048
    min_examples: int = 50

    @property
    def effective_batch(self) -> int:
        return self.batch_size * self.gradient_accumulation


def read_config(path: str) -> TuningConfig:
    """From JSON, TOML, or YAML if a YAML reader is installed. Unknown and missing keys are errors."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        own = json.loads(text)
    elif path.endswith(".toml"):
        own = tomllib.loads(text)
    else:
        try:
            import yaml
        except ImportError:
            raise ConfigError("YAML needs a reader that isn't installed.", "Use JSON or TOML.") from None
        own = yaml.safe_load(text)
    known = {f.name for f in fields(TuningConfig)}
    if extra := sorted(own.keys() - known):
        raise ConfigError(f"Unknown key(s): {', '.join(extra)}.")
    if missing := sorted({"base_model", "train_file", "output_dir"} - own.keys()):
        raise ConfigError(f"Missing key(s): {', '.join(missing)}.")
    for name in ("train_file", "eval_file", "output_dir"):
        if own.get(name):
            own[name] = str((Path(path).parent / own[name]).resolve())
    return TuningConfig(**own)


def with_answer(examples: DataFrame) -> DataFrame:
    """Conversations: the messages and the reference as the assistant's turn."""
    turn = F.struct(F.lit("assistant").alias("role"), F.coalesce("reference", F.lit("")).alias("content"))
    return examples.withColumn("conversation", F.concat("messages", F.array(turn)))


def prepare(good: DataFrame, bad: DataFrame, least: int, other: DataFrame | None = None) -> DataFrame:
    """Conversations of a dataset that has no bad line, no leak into `other`, an answer to every example and
    enough of them."""
    first = bad.orderBy("line").first()
    if first is not None:
        raise ConfigError(f"The training data has errors: line {first.line}: {first.message}.")
    counts = good.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reference").isNull()).alias("unanswered")).first()
    if counts.unanswered:
        raise ConfigError(f"{counts.unanswered} training example(s) have no 'reference'.", "Every one needs an answer to learn.")
    if counts.n < least:
        raise ConfigError(f"Only {counts.n} training example(s); at least {least} are required.", "Add data or lower min_examples.")
    if other is not None:
        leaked = va.leakage(va.keyed(good), va.keyed(other)).count()
        if leaked:
            raise ConfigError(f"{leaked} example(s) also appear in the held-out data.", "Remove them from one side.")
    return with_answer(good)


def plan(conversations: DataFrame, effective_batch: int, epochs: int) -> DataFrame:
    """One row: n_examples, steps_per_epoch, total_steps, median_words."""
    n_words = F.aggregate("conversation", F.lit(0), lambda a, m: a + F.size(words(m["content"])))
    steps = F.ceil(F.col("n_examples") / F.lit(effective_batch)).cast("long")
    one = conversations.select(n_words.alias("w")).agg(F.count(F.lit(1)).alias("n_examples"), F.median("w").alias("median_words"))
    return one.withColumn("steps_per_epoch", steps).withColumn("total_steps", F.col("steps_per_epoch") * epochs)


def steps(n: int, effective_batch: int, epochs: int) -> tuple[int, int]:
    per = ceil(n / effective_batch)
    return per, per * epochs


def rendered(conversations: DataFrame, template: Callable[[list[dict]], str]) -> DataFrame:
    """Each conversation as one training text by a chat template, vectorised over Arrow batches."""
    @F.pandas_udf("string")
    def f(x: pd.Series) -> pd.Series:
        return x.map(lambda turns: template([dict(t) for t in turns]))

    return conversations.withColumn("text", f("conversation"))


def check_truncation(lengths: DataFrame, length: str | Column, most: int) -> None:
    """Refuses when many texts are over the limit of tokens."""
    x = F.col(length) if isinstance(length, str) else length
    r = lengths.agg(F.count(F.lit(1)).alias("n"), F.count_if(x > most).alias("cut")).first()
    if r.n and r.cut / r.n > TRUNCATED:
        raise ConfigError(f"{r.cut} of {r.n} training examples exceed {most} tokens and would be cut off.", "Raise max_seq_len or shorten them.")
