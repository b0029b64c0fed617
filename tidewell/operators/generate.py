"""Answer text for a column of prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions.text import NO_ANSWER
from tidewell.operators.distinct import per_distinct
from tidewell.operators.models import once_per_worker
from tidewell.workspace import Workspace

# Fixed value: longest output a generator is asked for.
MAX_LENGTH = 512


class Generator(Protocol):
    """Anything that answers prompts, one text each."""

    def generate(self, prompts: list[str], max_length: int) -> list[str]: ...


def extractive_answer(best_chunk: Column) -> Column:
    """The offline default: the nearest chunk itself, or that there is none."""
    return F.coalesce(best_chunk, F.lit(NO_ANSWER))


def _answers(model: Generator, prompts: list[str], max_length: int) -> list[tuple[str | None, str | None]]:
    """(answer, failure) of each prompt. Where a batch fails its prompts are tried one by one."""
    try:
        found = model.generate(prompts, max_length)
        if len(found) != len(prompts):
            raise ValueError(f"{len(found)} answers to {len(prompts)} prompts")
        return [(None if answer is None else answer[:max_length], None) for answer in found]
    except Exception as error:  # a model's failure is a result, not the end of the job
        if len(prompts) == 1:
            return [(None, f"{type(error).__name__}: {error}")]
    return [pair for prompt in prompts for pair in _answers(model, [prompt], max_length)]


def generation(
    prompt: Column, generator: Callable[[], Generator], max_length: int = MAX_LENGTH
) -> Column:
    """struct<answer, failure> of a model that ``generator`` makes once per worker process.

    Answers have ``max_length`` characters at most. Equal prompts of a batch are asked once. A
    prompt that the model fails on has a null answer and the reason as its failure.
    """
    load = once_per_worker(generator)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for prompts in batches:
            coded = prompts.fill_null("").dictionary_encode()
            texts = coded.dictionary.to_pylist()
            pairs = _answers(model, texts, max_length) if texts else []
            columns = [pa.array([pair[i] for pair in pairs], pa.string()) for i in (0, 1)]
            yield pa.StructArray.from_arrays(
                [column.take(coded.indices) for column in columns], ["answer", "failure"]
            )

    return F.arrow_udf(run, "struct<answer: string, failure: string>")(prompt)


def generated_answer(
    prompt: Column, generator: Callable[[], Generator], max_length: int = MAX_LENGTH
) -> Column:
    """Answers of a model; where it fails, that there is none."""
    return F.coalesce(generation(prompt, generator, max_length)["answer"], F.lit(NO_ANSWER))


def generate_distinct(
    df: DataFrame,
    prompt_col: str,
    workspace: Workspace,
    generator: Callable[[], Generator],
    max_length: int = MAX_LENGTH,
) -> DataFrame:
    """``df``, a written table, with ``answer`` and ``failure``; each distinct prompt is asked once."""
    asked = per_distinct(
        df, prompt_col, workspace, lambda text: generation(text, generator, max_length), "_generated"
    )
    return asked.select(*df.columns, "_generated.answer", "_generated.failure")
