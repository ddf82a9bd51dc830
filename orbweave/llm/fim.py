"""Fill-in-middle transformation: one numpy kernel over the UTF-8 buffers of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.llm.common import plain, table, text_blocks, unused

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

# Classes of bytes: part of a character begun before, line feed, white space, any other.
INSIDE, FEED, BLANK, OTHER = range(4)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[0x80:0xC0] = INSIDE
CLASS[[32, 9, 11, 12, 13]] = BLANK
CLASS[10] = FEED


def _pairs(rule: Callable[[int, int], bool]) -> np.ndarray:
    return np.array([[rule(a, b) for b in range(4)] for a in range(4)])


#: Whether a unit begins between two bytes, by the classes of both.
BOUNDARY = {
    "line": _pairs(lambda a, b: a == FEED),
    "word": _pairs(lambda a, b: a in (FEED, BLANK) and b not in (FEED, BLANK)),
    "char": _pairs(lambda a, b: b != INSIDE),
}


def cut_units(data: np.ndarray, off: np.ndarray, unit: str, choose: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """(units, first cut, second cut, code points before each cut) of all rows at once.

    `data` holds the rows' bytes, `off` their bounds; choose(units) gives the units before
    each of the two cuts. Cuts are bytes within `data`.
    """
    kind = CLASS[data]
    starts = np.ones(len(data), bool)
    starts[1:] = BOUNDARY[unit][kind[:-1], kind[1:]]
    starts[off[:-1][off[:-1] < len(data)]] = True  # a row begins a unit
    seen = np.concatenate([[0], np.cumsum(starts)])
    chars = np.concatenate([[0], np.cumsum(kind != INSIDE)])
    units = np.diff(seen[off])  # sums start again with each row
    cuts = [np.minimum(np.searchsorted(seen, seen[off[:-1]] + k, "right") - 1, off[1:]) for k in choose(units)]
    return units, *cuts, *(chars[c] - chars[off[:-1]] for c in cuts)


def holds(column, marks: tuple[str, ...]) -> np.ndarray:
    import pyarrow.compute as pc

    found = np.zeros(len(column), bool)
    for m in marks:
        found |= pc.match_substring(column, m).to_numpy(zero_copy_only=False)
    return found


def assemble(data: np.ndarray, off: np.ndarray, a: np.ndarray, b: np.ndarray, form: np.ndarray, marks: tuple[str, str, str]):
    """The rows' new texts (form 0: plain, 1: psm, 2: spm) as an Arrow column."""
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(off) - 1
    bounds = np.empty(3 * n + 1, np.int64)
    bounds[:-1] = np.stack([off[:-1], a, b], axis=1).ravel()
    bounds[-1] = off[-1]
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 3 * n, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    at = 3 * np.arange(n)
    p, m, s = (pieces.take(pa.array(at + i)) for i in range(3))
    pre, suf, mid = (pa.scalar(x.encode(), pa.large_binary()) for x in marks)
    glue = pa.scalar(b"", pa.large_binary())
    join = lambda *parts: pc.binary_join_element_wise(*parts, glue)
    return pc.choose(pa.array(form), join(p, m, s), join(pre, p, suf, s, mid, m), join(suf, s, pre, p, mid, m)).view(pa.large_string())


def meet(x: str, y: str, same: bool) -> bool:
    """Whether the end of x may begin y, or x hold y, so that marks could be misread."""
    return any(x.endswith(y[:k]) for k in range(1, len(y) + (not same))) or not same and y in x


def draws(id_col: Column, seed: int) -> Column:
    """Four unsigned 32-bit numbers of a row: the first digits of a hash of seed and id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm_rate: int = 50, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with fim_units, fim_form, fim_prefix_chars, fim_middle_chars and fim_text.

    A text is cut before a unit ("line", "word" or "char"; a word takes the blanks after it,
    and blanks before a text's first word are a word) at two places that the row's id and
    the seed draw. Form psm gives prefix, suffix, middle, each behind its mark, and spm
    suffix, prefix, middle; `rate` of 100 rows are transformed, `spm_rate` of 100 of those
    as spm. Empty and null texts, and texts that hold a mark, stay plain: fim_text is the
    text, the lengths are null. Rows of one id are cut by the same draws, a null id draws
    like an empty one. Texts are cut whole, whatever their length; a task holds a block of
    1 MB of texts or one longer text, at some 30 bytes for each of its bytes. Columns of
    these five names in `docs` are replaced; an empty table gives no rows.
    """
    if unit not in BOUNDARY:
        raise ValueError(f"unit {unit!r} is none of {sorted(BOUNDARY)}")
    if len(marks) != 3 or not all(marks) or any(meet(x, y, i == j) for i, x in enumerate(marks) for j, y in enumerate(marks)):
        raise ValueError("marks must be three texts of which none can run into another")
    new = T.DataType.fromDDL("fim_units long, fim_form string, fim_prefix_chars long, fim_middle_chars long, fim_text string").fields
    docs = docs.drop(*[f.name for f in new])
    columns = docs.columns
    names = [f"c{i}" for i in range(len(columns) + len(new))]  # any names may be in docs
    schema = T.StructType([T.StructField(x, f.dataType) for x, f in zip(names, docs.schema.fields + new)])
    at = columns.index(text_col)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            text, h = batch.column(at), batch.column(len(columns))
            h = h.flatten().to_numpy().reshape(-1, 4)
            for i, j, data, off in text_blocks(text):
                d = h[i:j]
                choose = lambda n, d=d: (np.minimum(d[:, 0] % (n + 1), d[:, 1] % (n + 1)), np.maximum(d[:, 0] % (n + 1), d[:, 1] % (n + 1)))
                units, a, b, ca, cb = cut_units(data, off, unit, choose)
                same = (units == 0) | holds(pc.fill_null(text.slice(i, j - i), ""), marks) | (d[:, 2] % 100 >= rate)
                form = np.where(same, 0, np.where(d[:, 3] % 100 < spm_rate, 2, 1))
                made = assemble(data, off, a, b, form, marks)
                kind = pa.array(["plain", "psm", "spm"]).take(pa.array(form))
                rest = [batch.column(k).slice(i, j - i) for k in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(units), kind, pa.array(ca, mask=same), pa.array(cb - ca, mask=same), made.cast(pa.string())], names=names)

    (draw,) = unused(docs, "draw")
    drawn = docs.withColumn(draw, draws(F.col(id_col), seed)).toDF(*names[: len(columns)], "draw")
    return drawn.mapInArrow(run, schema).toDF(*columns, *[f.name for f in new])


def restored(fim_text: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that fill_in_middle() was given, from its output and form alone."""
    p = F.split(fim_text, "|".join(rf"\Q{m}\E" for m in marks), -1)
    part = lambda i: F.get(p, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(fim_text)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("fim_text"), F.col("fim_form"))
    return d.select(plain("doc_id"), F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"), F.sha2("fim_text", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h FROM documents),
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts, h,
  CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN right(text, 1) = chr(10) THEN 1 ELSE 0 END END AS n FROM d),
k AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS k1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS k2, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS s FROM l),
c AS (SELECT *, least(len(array_to_string(parts[1:least(k1, k2)], chr(10))) + CASE WHEN least(k1, k2) > 0 THEN 1 ELSE 0 END, len(text)) AS a,
  least(len(array_to_string(parts[1:greatest(k1, k2)], chr(10))) + CASE WHEN greatest(k1, k2) > 0 THEN 1 ELSE 0 END, len(text)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN s < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
x AS (SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1) AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m WHEN 'spm' THEN '<S>' || z || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
FROM x
"""
