"""Hashed embeddings as one column: the unit-length vector of each text, made in Arrow batches.

The terms are those of text.feature_terms and their buckets those of text.hashed_terms; here each distinct word of a batch is
hashed once, all words at the same time, and a text's vector never leaves its row."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import TAG_WEIGHT

VECTOR = "array<struct<dim:int,weight:double>>"
#: Texts, and their characters, that are hashed at a time, so that an Arrow batch of long texts is not expanded at once.
TEXTS, CHARACTERS = 4096, 4_000_000
_WORDS, _HAN = re.compile("[a-z0-9]+"), re.compile("[㐀-鿿]")


def fnv1a32(texts: list[str]) -> np.ndarray:
    """FNV-1a over the code points of texts as in text.fnv1a32, place by place over all that are as long."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    order = np.argsort(-lengths, kind="stable")
    starts, falling = (np.cumsum(lengths) - lengths)[order], -lengths[order]
    held = np.full(len(texts), 2166136261, np.uint64)
    for place in range(-int(falling[0]) if len(texts) else 0):
        n = int(np.searchsorted(falling, -place))
        held[:n] = ((held[:n] ^ codes[starts[:n] + place]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
    out = np.empty_like(held)
    out[order] = held
    return out


def _counted(low: str, tags: list[str]) -> Counter:
    """What a text in lower case holds, and how often: words, Han characters and pairs, tags, each with its mark."""
    han = _HAN.findall(low)
    held = Counter(f"w:{w}" for w in _WORDS.findall(low))
    held.update(f"c:{c}" for c in han)
    held.update(f"b:{a}{b}" for a, b in zip(han, han[1:], strict=False))
    for tag in tags:
        held[f"s:{tag}"] += TAG_WEIGHT
    return held


def _vectors(lows: list[str], tags: list[list[str]], dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of dimensions by text, dimensions, weights), in order."""
    number: dict[str, int] = {}
    rows, units, times = [], [], []
    for row, (low, of) in enumerate(zip(lows, tags, strict=True)):
        for unit, n in _counted(low, of).items():
            rows.append(row)
            units.append(number.setdefault(unit, len(number)))
            times.append(n)
    # a word is a term itself and gives its triples, anything else is one term
    terms, sizes = [], []
    for unit in number:
        word = unit[2:] if unit.startswith("w:") and len(unit) >= 6 else ""
        terms.append(unit)
        terms.extend(f"g:{word[i:i + 3]}" for i in range(len(word) - 2))
        sizes.append(max(1, len(word) - 1))
    hashes, sizes = fnv1a32(terms), np.array(sizes, np.int64)
    dim, sign = (hashes % np.uint64(dims)).astype(np.int64), np.where(hashes & np.uint64(0x80000000), -1.0, 1.0)
    starts = np.cumsum(sizes) - sizes
    rows, units, times = (np.array(x, np.int64) for x in (rows, units, times))
    out = []
    step = max(1, CHARACTERS // dims)
    for first in range(0, len(lows), step):
        lo, hi = np.searchsorted(rows, [first, first + step])
        n = sizes[units[lo:hi]]
        at = np.repeat(starts[units[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat(rows[lo:hi] - first, n) * dims + dim[at]
        count = min(step, len(lows) - first)
        sums = np.bincount(key, weights=sign[at] * np.repeat(times[lo:hi], n), minlength=count * dims).reshape(count, dims)
        r, d = np.nonzero(sums)
        out.append((np.bincount(r, minlength=count), d, sums[r, d] / np.sqrt((sums * sums).sum(axis=1))[r]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def _parts(lows: list[str]):
    """Slices of texts of bounded number and size; one text at least."""
    first, size = 0, 0
    for i, low in enumerate(lows):
        if i > first and (i - first >= TEXTS or size + len(low) > CHARACTERS):
            yield first, i
            first, size = i, 0
        size += len(low)
    if first < len(lows):
        yield first, len(lows)


def hashed_vector(text: Column | str, dims: int = 384, tags: Column | None = None, whole: bool = False) -> Column:
    """The hashed embedding of a text: (dim, weight) by dimension, of unit length, without weights of 0; null texts have none.
    whole: the weights of all dimensions, 0 included."""

    def vectors(low: pa.Array, tag: pa.Array) -> pa.Array:
        lows, of = low.to_pylist(), tag.to_pylist()
        parts = [_vectors(lows[a:b], of[a:b], dims) for a, b in _parts(lows)] or [_vectors([], [], dims)]
        n, dim, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
        if whole:
            all_ = np.zeros((len(n), dims))
            all_[np.repeat(np.arange(len(n)), n), dim] = weight
            return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * dims), pa.array(all_.ravel()))
        held = pa.StructArray.from_arrays([pa.array(dim.astype(np.int32)), pa.array(weight.astype(np.float64))], ["dim", "weight"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), held)

    low = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.arrow_udf(vectors, "array<double>" if whole else VECTOR)(low, F.coalesce(tags, F.array().cast("array<string>")) if tags is not None else F.array().cast("array<string>"))
