"""Fill-in-the-middle transformation over ropes.

A text is a balanced tree whose leaves hold runs of whole units (lines, or characters) and cache their
number of units and of code points. Two splits at unit ranks give prefix, middle and suffix; the subtrees are
concatenated in the order of the form, with leaves of sentinels between them. The way back splits the tree of the output
at the code points where its sentinels stand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import mapped_rows, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: Code points from which a leaf ends with the unit it is in.
LEAF = 1024


class Rope:
    """A leaf with ``text``, or a node with ``left`` and ``right``; counts of all below are cached. Never changed once made."""

    __slots__ = ("height", "left", "points", "right", "text", "units")

    def __init__(self, text: str = "", units: int = 0, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.units, self.points, self.height = units, len(text), 0
        else:
            self.units, self.points = left.units + right.units, left.points + right.points
            self.height = 1 + max(left.height, right.height)


def _leaves(text: str, unit: str) -> list[Rope]:
    out, at = [], 0
    while at < len(text):
        end = min(at + LEAF, len(text))
        if unit == "line" and end < len(text):
            end = text.find("\n", end - 1) + 1 or len(text)
        part = text[at:end]
        out.append(Rope(part, len(part) if unit == "char" else part.count("\n") + (part[-1] != "\n")))
        at = end
    return out


def rope(text: str, unit: str = "line") -> Rope:
    """The balanced rope of a text; a line longer than a leaf is one leaf."""
    leaves = _leaves(text, unit)
    return _built(leaves, 0, len(leaves)) if leaves else Rope()


def _built(leaves: list[Rope], a: int, b: int) -> Rope:
    if b - a == 1:
        return leaves[a]
    return Rope(left=_built(leaves, a, (a + b) // 2), right=_built(leaves, (a + b) // 2, b))


def concat(a: Rope, b: Rope) -> Rope:
    """Both in order; the higher tree is descended to where the other fits, so heights stay logarithmic."""
    if not a.points:
        return b
    if not b.points:
        return a
    if a.height > b.height + 1:
        return _balanced(a.left, concat(a.right, b))
    if b.height > a.height + 1:
        return _balanced(concat(a, b.left), b.right)
    return Rope(left=a, right=b)


def _balanced(a: Rope, b: Rope) -> Rope:
    """A node of two trees whose heights differ by two at most."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return Rope(left=a.left, right=Rope(left=a.right, right=b))
        return Rope(left=Rope(left=a.left, right=a.right.left), right=Rope(left=a.right.right, right=b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return Rope(left=Rope(left=a, right=b.left), right=b.right)
        return Rope(left=Rope(left=a, right=b.left.left), right=Rope(left=b.left.right, right=b.right))
    return Rope(left=a, right=b)


def split(tree: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """What lies before the unit, or the code point, of that rank, and the rest."""
    if rank <= 0:
        return Rope(), tree
    if rank >= getattr(tree, by):
        return tree, Rope()
    if tree.left is None:
        if by == "points" or tree.units == tree.points:  # every code point is a unit
            at = rank
        else:
            at = 0
            for _ in range(rank):
                at = tree.text.find("\n", at) + 1
        # a leaf that is cut between units keeps whole ones on either side
        first = rank if by == "units" else _units(tree.text[:at], tree)
        return Rope(tree.text[:at], first), Rope(tree.text[at:], max(tree.units - first, 0))
    inside = getattr(tree.left, by)
    if rank < inside:
        a, b = split(tree.left, rank, by)
        return a, concat(b, tree.right)
    a, b = split(tree.right, rank - inside, by)
    return concat(tree.left, a), b


def _units(text: str, of: Rope) -> int:
    return len(text) if of.units == of.points else text.count("\n")


def text_of(tree: Rope) -> str:
    parts, stack = [], [tree]
    while stack:
        at = stack.pop()
        if at.left is None:
            parts.append(at.text)
        else:
            stack += (at.right, at.left)
    return "".join(parts)


def plan(doc_id: int | None, n: int, text: str, seed: int, rate: int, spm_rate: int, sentinels: tuple[str, str, str]) -> tuple[int, int, str]:
    """Ends of prefix and middle in units, and the form, by four numbers of the id's SHA-256; a null id is empty."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    plain = not text or any(s in text for s in sentinels) or h3 % 100 >= rate
    return low, high, "plain" if plain else "spm" if h4 % 100 < spm_rate else "psm"


def rearranged(tree: Rope, low: int, high: int, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> tuple[Rope, int, int]:
    """The rope of a form other than plain, and the code points of prefix and middle."""
    head, suffix = split(tree, high)
    prefix, middle = split(head, low)
    p, s, m = (Rope(x) for x in sentinels)
    order = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    out = order[0]
    for part in order[1:]:
        out = concat(out, part)
    return out, prefix.points, middle.points


def restored(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text of an output: its rope, split where the sentinels stand. A sentinel can't arise across their edges."""
    if form == "plain":
        return output
    first, second, third = (sentinels[1], sentinels[0], sentinels[2]) if form == "spm" else sentinels
    b = output.index(second, len(first))
    c = output.index(third, b + len(second))
    rest, middle = split(rope(output, "char"), c, "points")
    rest, two = split(rest, b, "points")
    one, two, middle = (split(x, len(s), "points")[1] for x, s in ((rest, first), (two, second), (middle, third)))
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return text_of(concat(concat(prefix, middle), suffix))


def fill_in_middle(docs: DataFrame, id_column: str = "doc_id", text: str = "text", unit: str = "line", seed: int = 7, rate: int = 100, spm_rate: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``docs`` with ``fim_output``, ``form``, ``n`` (units), ``prefix_chars`` and ``middle_chars``. Map-only.

    Units are lines (``[^\\n]*\\n|[^\\n]+``), or characters with ``unit="char"``. ``rate`` and ``spm_rate`` are percents of
    texts that are transformed, and of those with the suffix first. A text that is empty, null (as empty) or holds a sentinel stays plain,
    with null for both counts. Draws follow from seed and id, so equal ids are cut alike and reruns agree. Columns of these names are replaced; others
    stay, whatever their names.
    """
    if any(a != b and a in b for a in sentinels for b in sentinels) or len(set(sentinels)) < 3 or not all(_borderless(s) for s in sentinels):
        raise ValueError("sentinels must be three strings that can't overlap")
    added = [("fim_output", T.StringType()), ("form", T.StringType()), ("n", T.LongType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType())]
    names = {x.lower() for x, _ in added}
    kept = docs.select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c.lower() not in names])

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            out: list[list] = [[] for _ in added]
            for doc_id, body in zip(batch.column(id_column).to_pylist(), batch.column(text).to_pylist(), strict=True):
                body = body or ""
                tree = rope(body, unit)
                low, high, form = plan(doc_id, tree.units, body, seed, rate, spm_rate, sentinels)
                if form == "plain":
                    row = (body, form, tree.units, None, None)
                else:
                    made, prefix, middle = rearranged(tree, low, high, form, sentinels)
                    row = (text_of(made), form, tree.units, prefix, middle)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            arrays = [pa.array(x, pa.string() if isinstance(t, T.StringType) else pa.int64()) for x, (_, t) in zip(out, added, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *[x for x, _ in added]])

    return mapped_rows(kept, turned, [T.StructField(*x) for x in added])


def _borderless(x: str) -> bool:
    return bool(x) and not any(x[:k] == x[-k:] for k in range(1, len(x)))


def fim_restored(docs: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``docs`` with ``restored_text``, rebuilt from ``fim_output`` and ``form`` alone; null where either is null."""
    kept = docs.drop("restored_text")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "fim_output"):
            pairs = zip(batch.column("fim_output").to_pylist(), batch.column("form").to_pylist(), strict=True)
            texts = [None if x is None or form is None else restored(x, form, sentinels) for x, form in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "restored_text"])

    return mapped_rows(kept, back, [T.StructField("restored_text", T.StringType())])


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
    sha256('7:' || doc_id::VARCHAR) AS h
  FROM documents
), drawn AS (
  SELECT *, len(lines)::BIGINT AS n,
    ('0x' || h[1:8])::BIGINT % (len(lines) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(lines) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(lines[1:least(a, b)], '') AS p,
    array_to_string(lines[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(lines[greatest(a, b) + 1:n], '') AS s
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE WHEN form = 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM parts
"""
