"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

Terms are weighted by the template collection (a word of no template has the highest weight), so
a file is scored where it lies, in one pass over the texts. A segment that shares none of a
template's anchors, its heaviest terms, can't reach the threshold by the Cauchy-Schwarz
inequality; only segments with an anchor are scored, which loses nothing. Inside lines and paragraphs
sentences and windows as long as a template are scored too, as a notice may share its line with other words.

Files without a licence of their own take that of the nearest directory above them that has a
licence file with one: distinct directories are joined to the licensed ones by their path prefixes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import slices, written

#: Notices of public licences by SPDX identifier, as they stand in headers and licence files.
TEMPLATES = (
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Licensed under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Templates and words of templates that one closure may hold.
MOST_TEMPLATES, MOST_TERMS = 2_000, 200_000
#: Base names of licence files: one of these words, then nothing, an extension or a suffix.
LICENSE_FILE = r"^(LICEN[CS]E|COPYING|COPYRIGHT|NOTICE|UNLICENSE)([.-].*)?$"
#: Cosine of a window inside a paragraph: at 0.6 two of three words would do ("all rights of").
WINDOW_LEAST = 0.8
SENTENCE = re.compile(r"(?<=[.!?;:])\s+")
TERM = re.compile(r"[^\W_]+")


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


class TemplateIndex:
    """TF-IDF vectors of templates as postings by term, and their anchors."""

    def __init__(self, templates: list[tuple[str, str]], least: float):
        counts = [(name, Counter(terms(text))) for name, text in sorted(templates)]
        frequency = Counter(t for _, c in counts for t in c)
        if len(counts) > MOST_TEMPLATES or len(frequency) > MOST_TERMS:
            raise ValueError("too many templates for one task")
        n = len(counts)
        self.least, self.names = least, [name for name, _ in counts]
        self.unknown = math.log(1 + n) + 1
        self.idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in frequency.items()}
        self.postings: dict[str, list[tuple[int, float]]] = {}
        self.anchors: set[str] = set()
        self.sizes, self.vectors = [c.total() for _, c in counts], []
        for k, (_, c) in enumerate(counts):
            weights = {t: tf * self.idf[t] for t, tf in c.items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            self.vectors.append({t: w / norm for t, w in weights.items()})
            rest = 1.0
            for t, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
                self.postings.setdefault(t, []).append((k, w / norm))
                if rest >= least * least * 0.999:
                    self.anchors.add(t)
                rest -= (w / norm) ** 2
        self._seen: dict[str, tuple[float, str] | None] = {}

    def pattern(self) -> str:
        """Finds texts that may hold an anchor; like any RE2 pattern, in linear time."""
        return "(?i)(" + "|".join(map(re.escape, sorted(self.anchors))) + ")" if self.anchors else r"[^\s\S]"

    def likely(self, present: set[str], least: float) -> list[int]:
        """Templates that share two terms with these and enough weight for a cosine of ``least``."""
        shared: dict[int, list[float]] = {}
        for t in present & self.idf.keys():
            for k, v in self.postings[t]:
                shared.setdefault(k, []).append(v * v)
        return [k for k, x in shared.items() if len(x) >= min(2, len(self.vectors[k])) and sum(x) >= least * least * 0.999]

    def windows(self, segment: list[str], k: int, least: float) -> tuple[float, str] | None:
        """Highest cosine of a template with the runs of as many terms of a segment, if it reaches ``least``."""
        n, vector, best = self.sizes[k], self.vectors[k], 0.0
        weight = [self.idf.get(t, self.unknown) for t in segment]
        counts: Counter[str] = Counter()
        norm = dot = 0.0
        for i, t in enumerate(segment):
            norm += (2 * counts[t] + 1) * weight[i] ** 2
            dot += weight[i] * vector.get(t, 0.0)
            counts[t] += 1
            if i >= n:
                gone = segment[i - n]
                counts[gone] -= 1
                norm -= (2 * counts[gone] + 1) * weight[i - n] ** 2
                dot -= weight[i - n] * vector.get(gone, 0.0)
            if i >= n - 1:
                best = max(best, dot / math.sqrt(norm))
        return (round(best, 9), self.names[k]) if round(best, 9) >= least else None

    def inside(self, text: str) -> list[tuple[float, str]]:
        """Sentences that share two terms with a template, by the threshold, and windows inside paragraphs, by WINDOW_LEAST or the threshold if it is higher."""
        bar, hits = max(self.least, WINDOW_LEAST), []
        if not self.likely(set(terms(text)), self.least):
            return hits
        for paragraph in re.split(r"\n[ \t\r]*\n", text):
            segment = terms(paragraph)
            if not self.likely(set(segment), self.least):
                continue
            for sentence in (x for line in paragraph.split("\n") for x in SENTENCE.split(line)):
                if (found := self.best(sentence)) and any(self.names[k] == found[1] for k in self.likely(set(terms(sentence)), self.least)):
                    hits.append(found)
            hits += [x for k in self.likely(set(segment), bar) if (x := self.windows(segment, k, bar))]
        return hits

    def best(self, segment: str) -> tuple[float, str] | None:
        """Highest cosine (to nine places) of a segment with a template and the first name that has it, if it reaches the threshold."""
        if segment in self._seen:
            return self._seen[segment]
        counts, found = Counter(terms(segment)), None
        if not self.anchors.isdisjoint(counts):
            norm, dots = 0.0, {}
            for t in sorted(counts):
                w = counts[t] * self.idf.get(t, self.unknown)
                norm += w * w
                for k, v in self.postings.get(t, ()):
                    dots[k] = dots.get(k, 0.0) + w * v
            found = min((-round(d / math.sqrt(norm), 9), self.names[k]) for k, d in dots.items())
            found = (-found[0], found[1]) if -found[0] >= self.least else None
        if len(segment) <= 400:
            if len(self._seen) > 50_000:
                self._seen.clear()
            self._seen[segment] = found
        return found

    def scan(self, text: str, whole: bool) -> tuple[float, str] | None:
        """The best of a text's lines and paragraphs, of what stands inside them, and of the whole text of a licence file."""
        hits = [self.best(x) for x in text.split("\n")]
        hits += [self.best(x) for x in re.split(r"\n[ \t\r]*\n", text) if "\n" in x]
        hits.append(self.best(text) if whole else None)
        hits += self.inside(text)
        return min((x for x in hits if x), key=lambda x: (-x[0], x[1]), default=None)


def directory(path: Column) -> Column:
    """A path without its last part: ``/a/b`` of ``/a/b/c``, empty for a file at the top, null for null."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def own_licenses(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.6, path: str = "path", text: str = "text") -> DataFrame:
    """Columns of ``files`` but the text, with ``own_license`` and ``own_score`` (null without one). Map-only, whole texts."""
    kept = files.drop("own_license", "own_score", "_file")
    rest = [f for f in kept.schema.fields if f.name != text]
    schema = T.StructType([*rest, T.StructField("own_license", T.StringType()), T.StructField("own_score", T.DoubleType())])
    index = TemplateIndex(list(templates), least)
    pattern = index.pattern()
    is_file = F.coalesce(F.upper(F.regexp_extract(path, r"([^/]*)$", 1)).rlike(LICENSE_FILE), F.lit(False))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts, whole = batch.column(text), batch.column("_file")
            names, scores = [None] * batch.num_rows, [None] * batch.num_rows
            maybe = pc.fill_null(pc.match_substring_regex(texts, pattern), False)
            for i in np.flatnonzero(maybe.to_numpy(zero_copy_only=False)).tolist():
                if found := index.scan(texts[i].as_py(), whole[i].as_py()):
                    scores[i], names[i] = found
            columns = [*[batch.column(f.name) for f in rest], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return kept.withColumn("_file", is_file).mapInArrow(scanned, schema)


def license_scan(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.6, path: str = "path", text: str = "text") -> DataFrame:
    """Columns of ``files`` but the text, with ``own_license``, ``own_score``, ``license`` and ``inherited_from``.

    ``license`` is the file's own, else that of the nearest directory at or above its own whose
    licence files have one (the best score, then the first name), and ``inherited_from`` is
    that directory; both are null where there is none. Null and empty texts have no licence, a
    null path inherits none. Repeated rows and paths are each answered. Columns of the added
    names are replaced.

    Texts are read once and never shuffled. The directory joins work on distinct directories, so
    a directory with a third of all files is one row there; the last join gives its rows the
    result by an equi-join that Spark may split or broadcast by size.
    """
    files = files.drop("license", "inherited_from")
    own = written(own_licenses(files, templates, least, path, text).withColumn("_dir", directory(F.col(path))), "licenses")
    named = F.upper(F.regexp_extract(path, r"([^/]*)$", 1)).rlike(LICENSE_FILE)
    best = F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("license")))
    licensed = own.filter(named & F.col("own_license").isNotNull()).groupBy("_dir").agg(best.alias("b")).select(F.col("_dir").alias("_above"), "b.license")
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    steps = own.filter("_dir IS NOT NULL").select("_dir").distinct().select("_dir", F.explode(above).alias("_above"))
    nearest = F.max(F.struct(F.length("_above").alias("n"), F.col("_above").alias("inherited_from"), F.col("license")))
    heirs = written(steps.join(licensed, "_above").groupBy("_dir").agg(nearest.alias("h")).select("_dir", "h.inherited_from", F.col("h.license").alias("_license")), "directories")
    mine = F.col("own_license").isNotNull()
    out = own.join(heirs.withColumnRenamed("_dir", "_heir"), F.col("_dir") == F.col("_heir"), "left")
    return out.select(
        *[c for c in own.columns if c != "_dir"],
        F.coalesce("own_license", "_license").alias("license"),
        F.when(~mine, F.col("inherited_from")).alias("inherited_from"),
    )


def files_of(documents: DataFrame) -> DataFrame:
    """Documents as files with a ``path``; as the table has no paths, a rule makes them.

    The source is the top directory, thousands and hundreds of ids are directories below it.
    By a hash of the id an eighth of the documents are licence files, at one of the three levels.
    """
    h = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 7), 16, 10).cast("long")
    top = F.concat(F.lit("/"), F.coalesce("source", F.lit("-")))
    second = F.concat(top, F.lit("/"), F.expr("doc_id div 1000"))
    third = F.concat(second, F.lit("/"), F.expr("doc_id div 100"))
    level = F.pmod(F.floor(h / 8), F.lit(3))
    place = F.when(level == 0, top).when(level == 1, second).otherwise(third)
    licence = h % 8 == 0
    path = F.when(licence, F.concat(place, F.lit("/LICENSE-"), F.col("doc_id"))).otherwise(F.concat(third, F.lit("/"), F.col("doc_id"), F.lit(".txt")))
    return documents.select("doc_id", "text", path.alias("path"))


_VALUES = ", ".join("('{}', '{}')".format(*x) for x in TEMPLATES)
ORACLE = rf"""
WITH templates(name, t) AS (VALUES {_VALUES}),
     words AS (SELECT name, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+')) AS w FROM templates),
     tf AS (SELECT name, w, count(*) AS n FROM words GROUP BY ALL),
     total AS (SELECT count(*) AS n FROM templates),
     idf AS (SELECT w, ln((1 + (SELECT n FROM total)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY w),
     weights AS (SELECT name, w, tf.n * idf AS v FROM tf JOIN idf USING (w)),
     vectors AS (SELECT name, w, v / sqrt(sum(v * v) OVER (PARTITION BY name)) AS v FROM weights),
     located AS (SELECT doc_id, coalesce(text, '') AS t, '/' || coalesce(source, '-') AS top, ('0x' || substr(md5(doc_id::VARCHAR), 1, 7))::BIGINT AS h FROM documents),
     files AS (SELECT doc_id, t, h % 8 = 0 AS licence,
                      CASE WHEN h % 8 <> 0 OR (h // 8) % 3 = 2 THEN top || '/' || doc_id // 1000 || '/' || doc_id // 100
                           WHEN (h // 8) % 3 = 1 THEN top || '/' || doc_id // 1000 ELSE top END AS dir FROM located),
     segments AS (SELECT doc_id, unnest(list_distinct(string_split(t, chr(10)) || regexp_split_to_array(t, '\n[ \t\r]*\n') || CASE WHEN licence THEN [t] ELSE [] END)) AS s FROM files),
     cues AS (SELECT doc_id, s FROM segments WHERE regexp_matches(lower(s), 'licen|right|domain|permi|redistrib|software|unencumbered|reserved|mozilla|cc|isc|mit|apache')),
     numbered AS (SELECT s, row_number() OVER () AS k FROM (SELECT DISTINCT s FROM cues)),
     counted AS (SELECT k, w, count(*) AS n FROM (SELECT k, unnest(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}]+')) AS w FROM numbered) GROUP BY ALL),
     weighed AS (SELECT k, w, n * coalesce(idf, ln(1 + (SELECT n FROM total)) + 1) AS v FROM counted LEFT JOIN idf USING (w)),
     norms AS (SELECT k, sqrt(sum(v * v)) AS norm FROM weighed GROUP BY k),
     cosines AS (SELECT k, name, round(sum(a.v * b.v) / any_value(norm), 9) AS score FROM weighed a JOIN vectors b USING (w) JOIN norms USING (k) GROUP BY ALL HAVING score >= 0.6),
     own AS (SELECT doc_id, min(struct_pack(s := -score, name := name)) AS b FROM cues JOIN numbered USING (s) JOIN cosines USING (k) GROUP BY doc_id),
     licensed AS (SELECT dir, min(b).name AS license FROM files JOIN own USING (doc_id) WHERE licence GROUP BY dir),
     heirs AS (SELECT f.doc_id, arg_max(l.dir, length(l.dir)) AS dir, arg_max(l.license, length(l.dir)) AS license
               FROM files f JOIN licensed l ON f.dir = l.dir OR starts_with(f.dir, l.dir || '/') GROUP BY f.doc_id)
SELECT f.doc_id, own.b.name AS own_license, -own.b.s AS own_score, coalesce(own.b.name, heirs.license) AS license,
       CASE WHEN own.b IS NULL THEN heirs.dir END AS inherited_from
FROM files f LEFT JOIN own USING (doc_id) LEFT JOIN heirs USING (doc_id)
"""
