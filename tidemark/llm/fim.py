"""Operator 13: fill-in-the-middle. A text becomes a UTF-32 array of code points;
where neighbours differ in class a unit ends, two units chosen by hashes of the
id cut it into prefix, middle and suffix, which change places."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_long, as_text

#: What stands before each piece.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("char", "word", "line")


@dataclass(frozen=True)
class Params:
    """unit: what is never cut through: a code point, a run of letters and
    digits or of white space (every other sign stands alone), or a line with its
    end. Of 100 texts fim_percent are transformed, of those spm_percent with the
    suffix first."""

    unit: str = "char"
    seed: int = 1
    fim_percent: int = 90
    spm_percent: int = 20


def _table() -> np.ndarray:
    """The class of each code point: 1 letter or digit, 2 white space, else 0."""
    out = np.zeros(0x110000, np.int8)
    for c in range(0x110000):
        x = chr(c)
        out[c] = 1 if x.isalnum() else 2 if x.isspace() else 0
    return out


_CLASS: list[np.ndarray] = []


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """Numbers that differ between neighbours exactly where a unit ends."""
    if unit == "char":
        return np.arange(len(points))
    if unit == "line":
        ends = points == 10
        return np.cumsum(ends) - ends
    if not _CLASS:
        _CLASS.append(_table())
    kind = _CLASS[0][points].astype(np.int64)
    return np.where(kind > 0, kind, 3 + np.arange(len(points)))


def edges(points: np.ndarray, unit: str) -> np.ndarray:
    """Where each unit begins, and after them the length."""
    k = classes(points, unit)
    inner = np.flatnonzero(k[1:] != k[:-1]) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def numbers(key: str) -> tuple[int, ...]:
    """The first four 8-digit groups of the SHA-256 of the key."""
    h = hashlib.sha256(key.encode()).hexdigest()
    return tuple(int(h[i: i + 8], 16) for i in range(0, 32, 8))


def transformed_text(text: str, key: str, p: Params) -> tuple[int, str, int | None, int | None, str]:
    """(code points, form, code points of the prefix, of the middle, output)."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    h1, h2, h3, h4 = numbers(key)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= p.fim_percent:
        return len(points), "plain", None, None, text
    at = edges(points, p.unit)
    a, b = sorted((int(at[h1 % len(at)]), int(at[h2 % len(at)])))
    pre, mid, suf = (x.tobytes().decode("utf-32-le") for x in (points[:a], points[a:b], points[b:]))
    if h4 % 100 < p.spm_percent:
        return len(points), "spm", a, b - a, f"{SUFFIX}{suf}{PREFIX}{pre}{MIDDLE}{mid}"
    return len(points), "psm", a, b - a, f"{PREFIX}{pre}{SUFFIX}{suf}{MIDDLE}{mid}"


_OUT = "doc_id string, n long, form string, prefix_chars long, middle_chars long, output string"


def transformed(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    The cuts depend on the id and the text alone, so rows are transformed one by
    one, without a shuffle; repeated rows come out alike, rows of one id with
    the same hashes. A null text is empty, an empty one plain; a null id is
    hashed as an empty string. Whole texts are cut, whatever their length. An
    empty table gives no rows; columns other than doc_id and text are not read.
    """
    if p.unit not in UNITS:
        raise ValueError(f"unknown unit {p.unit!r}")
    names = [c.split()[0] for c in _OUT.split(", ")]

    def run(batches):
        for pdf in batches:
            for low in range(0, len(pdf), 500):  # what goes back at once
                some = pdf.iloc[low: low + 500]
                rows = [(i, *transformed_text(t or "", f"{p.seed}:{'' if i is None else i}", p)) for i, t in zip(some["doc_id"], some["text"])]
                made = pd.DataFrame(rows, columns=names)
                yield made.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return as_long(docs.select(as_text("doc_id"), "text").mapInPandas(run, _OUT), "doc_id")


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form. No text that was cut holds a
    sentinel, so the output splits at its own three."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    pre, suf = (F.when(form == "psm", F.get(parts, F.lit(i))).otherwise(F.get(parts, F.lit(3 - i))) for i in (1, 2))
    return F.when(form == "plain", output).otherwise(F.concat(pre, F.get(parts, F.lit(3)), suf))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
