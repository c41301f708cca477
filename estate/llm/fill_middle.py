"""Fill-in-middle samples: texts cut into units and put together in another order.

Whole Arrow batches go through ``pyarrow.compute``: texts are split into lists of units,
the lists are flattened next to the row each unit came from, the place of a unit in its
row is counted, a filter per role picks its units, lists are built again from them and
joined into the three pieces of a row, and the pieces are joined row by row. No text is
looked at by Python. Restoring is another such pass.

A batch is worked through in slices of about ``SLICE_BYTES`` of text; a longer text is a
slice of its own, so a task holds a few times the longest text, never a few times a batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from estate.llm.common import ship

# Fixed values of the contract: marks before prefix, suffix and middle; what draws begin with.
MARKS = ("<P>", "<S>", "<M>")
SEED = 7
SLICE_BYTES = 4 << 20


def _text(value: str | None) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


_EMPTY = _text("")


def draws(key: Column, seed: int = SEED) -> Column:
    """Four numbers per row from its key alone: the first 32-bit groups of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)])


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """First row and number of rows of slices of about ``most`` bytes."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first = held = 0
    for row, more in enumerate(size.tolist()):
        if row > first and held + more > most:
            yield first, row - first
            first, held = row, 0
        held += more
    if len(size) > first:
        yield first, len(size) - first


def _lists(rows: np.ndarray, many: int, units: pa.Array) -> pa.Array:
    """Units with the row each belongs to, as one list per row."""
    ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=many))))
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), units)


def units_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """All lines with their ends: the units, the row and place of each, and units per row."""
    parts = pc.split_pattern(texts, "\n")
    rows = pc.list_parent_indices(parts).to_numpy()
    units = pc.list_flatten(parts)
    count = pc.list_value_length(parts).to_numpy()
    place = np.arange(len(rows)) - (np.cumsum(count) - count)[rows]
    last = pa.array(place == count[rows] - 1)
    units = pc.if_else(last, units, pc.binary_join_element_wise(units, _text("\n"), _EMPTY))
    # Behind the last line end there is an empty part, which is no unit.
    real = pc.not_equal(units, _EMPTY)
    rows, place = (a[real.to_numpy(zero_copy_only=False)] for a in (rows, place))
    return units.filter(real), rows, place, np.bincount(rows, minlength=len(texts))


def _pieces(texts: pa.Array, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Units per row, and prefix, middle and suffix of each row."""
    units, rows, place, n = units_of(texts)
    cuts = np.sort(np.stack([one % (n + 1), two % (n + 1)]), axis=0)
    role = (place >= cuts[0][rows]).astype(np.int8) + (place >= cuts[1][rows])
    pieces = []
    for wanted in range(3):
        own = role == wanted
        pieces.append(pc.binary_join(_lists(rows[own], len(texts), units.filter(pa.array(own))), _EMPTY))
    return n, pieces


def _check(marks: Sequence[str]) -> None:
    """No mark may begin as it ends, or one could be found a little before its place."""
    loops = any(m.startswith(m[i:]) for m in marks for i in range(1, len(m)))
    if len(set(marks)) != 3 or not all(marks) or loops:
        raise ValueError("three different marks are needed, none of which begins as it ends")


def _with_marks(marks: Sequence[str], order: Sequence[int], pieces: Sequence[pa.Array]) -> pa.Array:
    parts = [p for i in order for p in (_text(marks[i]), pieces[i])]
    return pc.binary_join_element_wise(*parts, _EMPTY)


# Of the marks and of (prefix, suffix, middle), in the order written.
_PSM, _SPM = (0, 1, 2), (1, 0, 2)


def _transform(texts: pa.Array, drawn: np.ndarray, marks: Sequence[str], rate: int, spm: int) -> list[pa.Array]:
    texts = pc.fill_null(texts.cast(pa.large_string()), _EMPTY)
    n, (prefix, middle, suffix) = _pieces(texts, drawn[:, 0], drawn[:, 1])
    plain = pc.or_(pc.equal(texts, _EMPTY), pa.array(drawn[:, 2] % 100 >= rate))
    for mark in marks:
        plain = pc.or_(plain, pc.match_substring(texts, mark))
    other = pa.array(drawn[:, 3] % 100 < spm)
    by_mark = (prefix, suffix, middle)
    form = pc.if_else(plain, "plain", pc.if_else(other, "spm", "psm"))
    out = pc.if_else(other, _with_marks(marks, _SPM, by_mark), _with_marks(marks, _PSM, by_mark))
    none = pa.scalar(None, pa.int64())
    return [
        pa.array(n, pa.int64()), form, pc.if_else(plain, none, pc.utf8_length(prefix).cast(pa.int64())),
        pc.if_else(plain, none, pc.utf8_length(middle).cast(pa.int64())), pc.if_else(plain, texts, out),
    ]


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", marks: Sequence[str] = MARKS, rate: int = 100,
    spm: int = 50, seed: int = SEED,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n``, ``form``, ``prefix_chars``,
    ``middle_chars``, ``output``.

    A text is cut into its ``n`` lines, line ends included. Two numbers drawn from the
    key alone pick the places where prefix and middle end; ``rate`` percent of the rows
    are put together anew, ``spm`` percent of these with the suffix first, the rest with
    the prefix first, and the middle always last. Others are ``plain`` and keep their
    text, and so do empty texts and those that hold a mark, as they could not be told
    apart again; their character counts are null. Null texts count as empty ones, and a
    null key draws as an empty one. Rows of one key draw alike; repeated rows stay as
    many. A text of any length is one row and needs a few times its own size. Other
    columns are not read. An empty table gives no rows.
    """
    _check(marks)
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), draws(F.col(key), seed).alias("draws"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    marks = tuple(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, many in slices(batch["text"]):
                part = batch.slice(first, many)
                drawn = part["draws"].flatten().to_numpy().reshape(many, 4)
                done = _transform(part["text"], drawn, marks, rate, spm)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], *done[:1], done[1].cast(pa.string()), *done[2:4], done[4].cast(pa.string())], names
                )

    return rows.mapInArrow(
        run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    )


def _restored(output: pa.Array, form: pa.Array, marks: Sequence[str]) -> pa.Array:
    """Each output split at its marks and joined in the order of the text."""
    output = output.cast(pa.large_string())
    plain = pc.equal(form, "plain")
    out = output.filter(plain)
    back = [(np.flatnonzero(plain.to_numpy(zero_copy_only=False)), out)]
    for name, order in (("psm", _PSM), ("spm", _SPM)):
        own = pc.equal(form, name)
        rest, pieces = output.filter(own), {}
        # Only the first place of a mark is one: no text with marks has a form.
        for i, following in zip(order, (*order[1:], None)):
            rest = pc.utf8_slice_codeunits(rest, len(marks[i]))
            if following is None:
                pieces[i] = rest
                continue
            at = pc.split_pattern(rest, marks[following], max_splits=1)
            pieces[i] = pc.list_element(at, 0)
            rest = pc.binary_join_element_wise(_text(marks[following]), pc.list_element(at, 1), _EMPTY)
        joined = pc.binary_join_element_wise(pieces[0], pieces[2], pieces[1], _EMPTY)
        back.append((np.flatnonzero(own.to_numpy(zero_copy_only=False)), joined))
    where = np.argsort(np.concatenate([at for at, _ in back]), kind="stable")
    return pa.concat_arrays([a for _, a in back]).take(pa.array(where))


def restore(samples: DataFrame, marks: Sequence[str] = MARKS) -> DataFrame:
    """``samples`` with the text rebuilt from ``output`` and ``form`` alone, as ``restored``.

    Rows with a null in either have a null there. All other columns are kept.
    """
    _check(marks)
    ship(samples.sparkSession)
    schema = StructType([*samples.schema.fields, StructField("restored", StringType())])
    marks = tuple(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, many in slices(batch["output"]):
                part = batch.slice(first, many)
                known = pc.and_(pc.is_valid(part["output"]), pc.is_valid(part["form"]))
                form = pc.if_else(known, part["form"], "plain")
                back = _restored(pc.if_else(known, part["output"], ""), form, marks)
                back = pc.if_else(known, back, _text(None))
                yield pa.RecordBatch.from_arrays([*part.columns, back.cast(pa.string())], [*part.schema.names, "restored"])

    return samples.mapInArrow(run, schema)
