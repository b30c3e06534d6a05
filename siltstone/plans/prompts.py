"""Which blocks of pages a model is shown, and its prompts, as columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import prompt
from .pages import BLOCK
from .schema import Schema

BLOCKS = T.ArrayType(BLOCK)


def _plain(blocks) -> list[dict]:
    return blocks or []


def block_scores(blocks: Column, words: set[str]) -> Column:
    """A score for each of a page's blocks."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def scored(pages: pa.Array) -> pa.Array:
        return pa.array([prompt.scores(_plain(p.as_py()), words) for p in pages], pa.list_(pa.float64()))

    return scored(blocks)


def chosen_blocks(blocks: Column, words: set[str]) -> Column:
    """The places of the blocks that fit the budget of a prompt, in page order."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def chosen(pages: pa.Array) -> pa.Array:
        return pa.array([prompt.chosen(_plain(p.as_py()), words) for p in pages], pa.list_(pa.int32()))

    return chosen(blocks)


def prompts(url: Column, title: Column, solved: Column, blocks: Column, schema: Schema) -> Column:
    """The prompt of each page: for the schema's fields that are not among ``solved``, an array."""
    fields = {f.name: {"type": f.type, "description": f.description, "aliases": list(f.aliases)} for f in schema.fields}

    @F.arrow_udf(T.StringType())
    def build(urls: pa.Array, titles: pa.Array, done: pa.Array, pages: pa.Array) -> pa.Array:
        rows = zip(urls.to_pylist(), titles.to_pylist(), done.to_pylist(), pages.to_pylist(), strict=True)
        return pa.array([prompt.prompt(u or "", t or "", fields, set(s or ()), _plain(b)) for u, t, s, b in rows], pa.string())

    return build(url, title, solved, blocks)
