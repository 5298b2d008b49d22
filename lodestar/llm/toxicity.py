"""Toxicity scores: a learned lexicon, fuzzy matches by Levenshtein automata, and context.

The lexicon is learned from a bounded sample of labelled documents. Words of the
corpus are matched to it exactly, by stem, or by a Levenshtein automaton of the word
that walks the lexicon's trie. The window around a hit tells quotation from abuse; a logistic
regression over the summed evidence gives the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import kept_parts, slices, words, written

#: Signs that stand for letters inside a word; at its ends they are punctuation.
INNER = "@$!*"
NOT_WORD = r"[^\p{L}\p{N}@$!*]+"
WORD = regex.compile(r"[\p{L}\p{N}@$!*]+")
QUOTED = regex.compile("\"[^\"]*+\"|“[^”]*+”|«[^»]*+»|„[^“”]*+[“”]")
#: Fixed lists of the context score: words that report another's speech, and words that address someone.
REPORTS = frozenset("said says quote quoted quotes called wrote term word cited dijo dice palabra dit mot cite sagte wort zitat".split())
ADDRESS = frozenset("you your youre u tu tú vous du ihr dich eres".split())
#: Key of a trie's node for the most edits that a term below it allows; no word holds it.
BELOW = "+"
#: Words before and after a hit that its context score reads.
REACH = 8


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Row offsets and lower-cased words, signs trimmed from their ends; some may be empty."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), NOT_WORD, " ")
    offsets, flat = kept_parts(pc.split_pattern(spaced, " "))
    coded = flat.dictionary_encode()
    trimmed = pc.utf8_trim(coded.dictionary, characters=INNER)
    return offsets, pa.DictionaryArray.from_arrays(coded.indices, trimmed)


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


@dataclass
class Lexicon:
    """Terms and stems with their strengths, from 0 to 1, and what is known of near words."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    variants: dict[str, float] = field(default_factory=dict)
    unseen: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.trie: dict = {}
        for term in self.words:
            node, edits = self.trie, allowed_edits(term)
            for c in term:
                node[BELOW] = max(node.get(BELOW, 0), edits)
                node = node.setdefault(c, {})
            node[BELOW], node[""] = max(node.get(BELOW, 0), edits), term

    def near(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its allowed edits, smallest first among equals, and its distance.

        Bit i of ``states[e]`` says that i characters of the word are read with e
        edits; the states move along the trie and a branch ends when none is left. A branch has states
        for as many edits as a term below it allows.
        """
        n = len(word)
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        whole = (1 << (n + 1)) - 1
        best: tuple[int, str] | None = None
        todo = [(self.trie, [((1 << (e + 1)) - 1) & whole for e in range(self.trie.get(BELOW, 0) + 1)])]
        while todo:
            node, states = todo.pop()
            for c, child in node.items():
                if c == "":
                    e = next((e for e, s in enumerate(states) if s >> n & 1), None)
                    if e is not None and e <= allowed_edits(child) and (best is None or (e, child) < best):
                        best = (e, child)
                    continue
                if c == BELOW:
                    continue
                mask = masks.get(c, 0)
                last = (states[0] & mask) << 1 & whole
                moved = [last]
                for e in range(1, child[BELOW] + 1):
                    last = ((states[e] & mask) << 1 | states[e - 1] | states[e - 1] << 1 | last << 1) & whole
                    moved.append(last)
                if last:
                    todo.append((child, moved))
        return best and (best[1], best[0])

    def maybe_near(self, found: pa.Array) -> np.ndarray:
        """Words that can be near a term, by its length and parts: edits leave its beginning, its end or, two of them on both sides, its middle."""
        sizes = pc.utf8_length(found).to_numpy(zero_copy_only=False)
        out = np.zeros(len(found), bool)
        for n in sorted({len(t) for t in self.words if allowed_edits(t)}):
            terms = [t for t in self.words if len(t) == n]
            edits = allowed_edits(terms[0])
            at = np.flatnonzero((np.abs(sizes - n) <= edits) & ~out)
            if not len(at):
                continue
            some = found.take(pa.array(at))
            head = n // (edits + 1)
            tail = n - head * edits
            parts = [(0, head, 0, head), (-tail, None, -tail, None)]
            if edits > 1:
                parts += [(head, 2 * head, head + shift, 2 * head + shift) for shift in (-1, 0, 1)]
            hit = np.zeros(len(at), bool)
            for a, b, i, j in parts:
                values = pa.array(sorted({t[a:b] for t in terms}), pa.string())
                hit |= pc.is_in(pc.utf8_slice_codeunits(some, i, j), value_set=values).to_numpy(zero_copy_only=False)
            out[at[hit]] = True
        return out

    def strengths(self, found: pa.Array, seen: dict[str, float], near_only: bool = False) -> np.ndarray:
        """Evidence of each distinct word, 0 for most. ``seen`` caches what automata found."""
        out = np.zeros(len(found))
        if not near_only:
            if self.words:
                table = pa.array(list(self.words), pa.string())
                at = pc.index_in(found, value_set=table)
                hit = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
                values = np.array(list(self.words.values()))
                out[hit] = values[at.take(pa.array(hit)).to_numpy(zero_copy_only=False)]
            for n in sorted({len(s) for s in self.stems}):
                heads = pc.utf8_slice_codeunits(found, 0, n)
                hit = pc.is_in(heads, value_set=pa.array([s for s in self.stems if len(s) == n], pa.string()))
                for i in np.flatnonzero(hit.to_numpy(zero_copy_only=False)):
                    out[i] = max(out[i], self.stems[heads[int(i)].as_py()])
        if self.unseen:
            for i in np.flatnonzero((out == 0) & self.maybe_near(found)):
                word = found[int(i)].as_py()
                if word not in seen:
                    if len(seen) > 300_000:
                        seen.clear()
                    hit = self.near(word)
                    seen[word] = self.variants.get(word, self.unseen[hit[0]]) if hit else 0.0
                out[i] = seen[word]
        return out


def context_weight(words: list[str], at: int, quoted: bool) -> float:
    """From 0 to 1: how far a hit at word ``at`` is used, rather than quoted or reported."""
    around = words[max(0, at - REACH) : at] + words[at + 1 : at + 1 + REACH]
    reports, address = sum(w in REPORTS for w in around), sum(w in ADDRESS for w in around)
    return 1 / (1 + math.exp(-(2.0 - 2.5 * quoted - 1.0 * min(reports, 2) + 1.0 * min(address, 2))))


def evidence(text: str, strength: dict[str, float]) -> list[float]:
    """Features of one text with hits: noisy-or of the used hits, log of their sum, noisy-or of the quoted."""
    low = text.lower()
    spans = [m.span() for m in QUOTED.finditer(low)]
    starts = [s for s, _ in spans]
    found = [(m.start(), m[0].strip(INNER)) for m in WORD.finditer(low)]
    said = [w for _, w in found]
    used, total, quotes = 1.0, 0.0, 1.0
    for k, (at, word) in enumerate(found):
        s = strength.get(word, 0.0)
        if s:
            i = int(np.searchsorted(starts, at, side="right")) - 1
            quoted = i >= 0 and at < spans[i][1]
            weight = context_weight(said, k, quoted)
            used *= 1 - s * weight
            total += s * weight
            if quoted:
                quotes *= 1 - s
    return [1 - used, math.log1p(total), 1 - quotes]


#: Coefficients before learning (bias, used, amount, quoted) and the weight of this belief.
PRIOR, BELIEF = np.array([-3.0, 5.0, 1.0, -0.5]), 0.5
#: Rate of toxic documents that a word near a term is believed to have before counting.
NEAR_RATE = 0.75
#: Evidence below this isn't worth a look at its context.
LEAST = 0.05


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray

    def features(self, texts: pa.Array, seen: dict[str, float]) -> np.ndarray:
        offsets, coded = tokens(texts)
        strength = self.lexicon.strengths(coded.dictionary, seen)
        strength[strength < LEAST] = 0.0
        codes = coded.indices.to_numpy(zero_copy_only=False)
        out = np.zeros((len(texts), 3))
        if not len(codes):
            return out
        hits = np.flatnonzero(strength[codes] > 0)
        rows = np.searchsorted(offsets, hits, side="right") - 1
        for row in np.unique(rows):
            mine = codes[hits[rows == row]] if len(hits) < 5000 else codes[hits[np.searchsorted(rows, row) : np.searchsorted(rows, row, side="right")]]
            table = {coded.dictionary[int(c)].as_py(): float(strength[c]) for c in np.unique(mine)}
            out[row] = evidence(texts[int(row)].as_py(), table)
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.weights[0] + features @ self.weights[1:])))


def fit_weights(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic regression around the prior coefficients, by Newton's method with step halving."""
    x = np.hstack([np.ones((len(features), 1)), features])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - labels @ z + BELIEF / 2 * ((w - PRIOR) ** 2).sum())

    w = PRIOR.copy()
    for _ in range(50 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + BELIEF * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + BELIEF * np.eye(len(w)), gradient)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _surprise(positive, negative, base: float):
    """Log-likelihood gain of a term's own rate over the base rate, in nats; columns or numbers."""
    rate = positive / (positive + negative)
    other = F.when(negative > 0, negative * F.log((1 - rate) / (1 - base))).otherwise(0.0)
    return F.when(rate > base, positive * F.log(rate / base) + other).otherwise(0.0)


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts with their label: at most ``max_train`` labelled ids, by smallest hash.

    Copies count once, or what their text happens to hold would look significant.
    Only ids whose CRC-32 as text isn't divisible by five are used. Ids with several labels
    count as toxic if one says so. The sample's bound makes the broadcast of its ids safe.
    """
    known = labels.filter(F.col(id_column).isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col(id_column).cast("string")) % 5 != 0))
    once = known.groupBy(id_column).agg(F.max("toxic").alias("_toxic"))
    sample = once.orderBy(F.xxhash64(id_column), id_column).limit(max_train).select(F.col(id_column).alias("_id"), "_toxic")
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("text")).join(F.broadcast(sample), "_id").select("text", (F.col("_toxic") == 1).alias("toxic"))
    one = F.max(F.struct("toxic", "text"))
    return rows.mapInArrow(_clustered, "text string, toxic boolean, cluster long").groupBy("cluster").agg(one.alias("r")).select("r.text", "r.toxic")


def _clustered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest hash of four words in a row, which copies and most near copies share."""
    for batch in slices(batches, "text"):
        offsets, flat = words(batch.column("text"))
        terms = flat.cast(pa.binary()).to_pylist()
        least = []
        for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            least.append(min((xxhash.xxh64_intdigest(b" ".join(terms[k : min(k + 4, j)])) >> 1 for k in range(i, max(i + 1, j - 3)) if i < j), default=0))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["text", "toxic", "cluster"])


def _word_counts(rows: DataFrame) -> DataFrame:
    """Of each word, how many toxic and other texts have it."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            offsets, coded = tokens(batch.column("text"))
            n = len(coded.dictionary)
            if not n:
                continue
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            pairs = np.unique(owner * n + coded.indices.to_numpy(zero_copy_only=False))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)[pairs // n]
            positive = np.bincount(pairs[toxic] % n, minlength=n)
            negative = np.bincount(pairs[~toxic] % n, minlength=n)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(positive), pa.array(negative)], names=["word", "positive", "negative"])

    parts = rows.mapInArrow(counted, "word string, positive long, negative long")
    return parts.groupBy("word").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative")).filter("length(word) BETWEEN 2 AND 64")


def train(docs: DataFrame, labels: DataFrame, max_train: int = 16_000, id_column: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Learns the lexicon and the weights from at most ``max_train`` labelled documents.

    A word enters if its rate of toxic documents is over the base rate by more than chance
    among all words tried; a stem of 4 to 8 characters if that holds for it and three words or
    more have it. All terms that pass reach the driver; the sample bounds them. Words of the sample that an
    automaton finds near a term keep their own shrunk rate, unseen ones get that of the term's near words.
    A strength is how far a rate is over the base rate, on the way to 1.
    Without labels of both classes nothing is learned and every score is the prior's.
    """
    rows = written(training_rows(docs, labels, max_train, id_column, text), "labelled")
    total = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not total.get(True) or not total.get(False):
        return ToxicityModel(Lexicon(), PRIOR.copy())
    base = total[True] / (total[True] + total[False])
    counts = written(_word_counts(rows), "words")

    def terms(found: DataFrame, margin: float) -> dict[str, float]:
        tried = found.filter("positive >= 3").withColumn("gain", _surprise(F.col("positive"), F.col("negative"), base))
        least = math.log(max(1, tried.count())) + margin
        rate = (F.col("positive") + 0.5) / (F.col("positive") + F.col("negative") + 1)
        best = tried.filter((F.col("gain") > least) & (rate > max(0.6, base)))
        return {r.word: (r.rate - base) / (1 - base) for r in sorted(best.select("word", rate.alias("rate")).collect())}

    cut = F.explode(F.transform(F.sequence(F.lit(4), F.lit(8)), lambda n: F.when(F.length("word") > n, F.substring(F.col("word"), F.lit(1), n))))
    stems = counts.filter("length(word) > 4").select(cut.alias("stem"), "positive", "negative").filter("stem IS NOT NULL")
    stems = stems.groupBy(F.col("stem").alias("word")).agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"), F.sum((F.col("positive") > 0).cast("int")).alias("words"))
    chosen = {s: r for s, r in terms(stems.filter("words >= 3 AND negative * 6 <= positive"), 6.0).items()}
    chosen = {s: r for s, r in chosen.items() if not any(s[:n] in chosen for n in range(4, len(s)))}
    known = terms(counts, 3.0)
    lexicon = Lexicon(known, chosen, {}, dict.fromkeys(known, 1.0))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, float] = {}
        for batch in batches:
            found = batch.column("word")
            clear = Lexicon(known, chosen).strengths(found, {}) > 0
            near = (lexicon.strengths(found, seen, near_only=True) > 0) & ~clear
            yield batch.filter(pa.array(near))

    near = counts.mapInArrow(close, counts.schema).collect() if known else []
    rate = lambda p, n, prior: (p + 2 * prior) / (p + n + 2)
    above = lambda r: max(0.0, (r - base) / (1 - base))
    around = {term: [0, 0] for term in known}
    owner = {r.word: lexicon.near(r.word)[0] for r in near}
    for r in near:
        around[owner[r.word]][0] += r.positive
        around[owner[r.word]][1] += r.negative
    common = {term: rate(p, n, NEAR_RATE) for term, (p, n) in around.items()}
    variants = {r.word: above(rate(r.positive, r.negative, common[owner[r.word]])) for r in near}
    unseen = {term: above(r) for term, r in common.items()}
    model = ToxicityModel(Lexicon(known, chosen, variants, unseen), PRIOR.copy())

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, float] = {}
        for batch in slices(batches, "text"):
            x = model.features(batch.column("text"), seen)
            yield pa.RecordBatch.from_arrays([*[pa.array(x[:, k]) for k in range(3)], batch.column("toxic")], names=["a", "b", "c", "toxic"])

    sample = rows.mapInArrow(featured, "a double, b double, c double, toxic boolean").toPandas()
    order = sample.sort_values(list("abc") + ["toxic"])
    model.weights = fit_weights(order[["a", "b", "c"]].to_numpy(), order["toxic"].to_numpy(dtype=float))
    return model


def toxicity_scores(docs: DataFrame, model: ToxicityModel, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), or columns of other ``names``. Map-only, over whole texts.

    Null and empty texts have no hits and get the score of the bias. Columns of the two
    added names are replaced.
    """
    kept = docs.drop(*names)
    schema = T.StructType([*kept.schema.fields, T.StructField(names[0], T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, float] = {}
        for batch in slices(batches, text):
            score = model.scores(model.features(batch.column(text), seen))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, names[0]])

    return kept.mapInArrow(scored, schema).withColumn(names[1], (F.col(names[0]) >= 0.5).cast("int"))


def held_out(id_column: str = "doc_id"):
    """Whether a document's label isn't used for learning."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 0, F.lit(False))
