"""License scans (operator 12): a positional index of licence words, anchored at the words that are rarest in the corpus.

Templates are texts of licences, or parts of them, as words. One pass over the documents writes, for each file, the places
of the words that occur in any template; counts of the files that hold each word give its IDF over all documents. A
scan then reads these places alone. Each template is looked up by the word of highest IDF of its first mandatory phrase:
each place of that word in a file, less its place in the phrase, is a place where the template may start. The
postings of the other words of the template are intersected with these starts by their relative position: all words of
all mandatory phrases have to stand where the template has them. Since every such place holds the anchor, none is missed,
whichever word is the rarest. What is left of the template counts into the share of its words found in
their places; a template of at least its least share gives its label, and the largest share is the file's score.

Words are maximal runs of digits, letters and all characters beyond ASCII, after lower-casing A-Z, so line breaks and
comment marks don't matter. Null and empty texts have no words: null places, empty labels, score 0. Repeated rows
are files each. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acutance.llm.chunks import squeeze, unsqueeze
from acutance.llm.common import lower_ascii, text_slices, tidy
from acutance.llm.terms import ALNUM, WORD, runs_of, values_of
from acutance.session import materialise, ship_package


@dataclass(frozen=True)
class Template:
    """A licence's label, its words, the phrases that must stand in it, and the least share of its words to be found in place."""

    label: str
    text: str
    phrases: tuple[str, ...]
    share: float = 1.0
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def spans(self) -> list[tuple[int, int]]:
        """First and end word of each mandatory phrase in the template; the first one holds the anchor."""
        out = []
        for phrase in self.phrases:
            n = len(phrase.split())
            out.append(next((i, i + n) for i in range(len(self.words) - n + 1) if self.words[i : i + n] == phrase.split()))
        return out


#: The phrases of the base labels.
BASE = [
    Template("gpl", "gnu general public license", ("gnu general public license",), base=True),
    Template("apache", "apache license", ("apache license",), base=True),
    Template("cc-by", "cc by", ("cc by",), base=True),
    Template("mit", "mit license", ("mit license",), base=True),
]

#: Wordings of public licences and of their notices, in lower case and without punctuation.
NOTICES = [
    Template("agpl", "gnu affero general public license", ("gnu affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",), 0.5),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("may not use this file except in compliance with the license",), 0.5),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "are permitted"), 0.7),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("names of its contributors may be used to endorse or promote products",), 0.6),
    Template("cc-by-nc", "licensed under cc by nc", ("cc by nc",), 0.6),
    Template("cc-by-nd", "licensed under cc by nd", ("cc by nd",), 0.6),
    Template("cc-by-sa", "licensed under cc by sa", ("cc by sa",), 0.6),
    Template("cc0", "cc0 1 0 universal", ("cc0 1 0",), 0.7),
    Template("gpl-2.0", "gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",), 0.5),
    Template("gpl-or-later", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license as published by the free software foundation", "any later version"), 0.8),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee is hereby granted",), 0.6),
    Template("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction"), 0.8),
    Template("mit", "released under the mit license", ("under the mit license",), 0.8),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",), 0.5),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",), 0.6),
]
TEMPLATES = BASE + NOTICES
FILES = 512


def vocabulary(templates: list[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def index_files(docs: DataFrame, vocab: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(keys, n, body): the written index, a row for up to FILES files: their keys and numbers of words, and for each file the places and codes of the words of vocab."""
    ship_package(docs.sparkSession)
    schema = T.StructType().add("keys", T.ArrayType(docs.schema[key].dataType)).add("body", "binary")
    wanted = pa.array([w.encode() for w in vocab], pa.large_binary())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FILES):
                some = batch.slice(at, FILES)
                sizes, counts, places, codes = [], [], [], []
                for lo, hi, data, offsets in text_slices(some.column(text)):
                    lower = lower_ascii(data)
                    mask = ALNUM[lower] == WORD
                    starts, ends, rows = runs_of(mask, offsets)
                    code = pc.index_in(values_of(lower, mask, starts, ends), value_set=wanted).fill_null(-1).to_numpy()
                    n = np.bincount(rows, minlength=hi - lo)
                    hit = np.flatnonzero(code >= 0)
                    sizes.append(n)
                    counts.append(np.bincount(rows[hit], minlength=hi - lo))
                    places.append(hit - (np.cumsum(n) - n)[rows[hit]])
                    codes.append(code[hit])
                join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
                body = squeeze(join(sizes, np.int64), join(counts, np.uint32), join(places, np.uint32), join(codes, np.uint16))
                yield pa.RecordBatch.from_arrays([pa.array([some.column(key).to_pylist()], pa.list_(some.schema.field(key).type)), pa.array([body], pa.binary())], schema.names)

    return materialise(docs.select(key, text).mapInArrow(run, schema), "licence-index")


def idf_of(index: DataFrame, words: int) -> np.ndarray:
    """The IDF of each word over all files: a number for each word of the templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, files = np.zeros(words, np.int64), 0
        for batch in batches:
            for body in batch.column("body"):
                sizes, counts, _, codes = unsqueeze(body.as_py())
                both = np.unique(np.repeat(np.arange(len(counts)), counts) * words + codes)
                held += np.bincount(both % words, minlength=words)
                files += len(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(words + 1)), pa.array(np.append(held, files))], ["code", "n"])

    got = {r.code: r.n for r in index.select("body").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()}
    n = got.get(words, 0)
    return np.array([math.log((n + 1) / (got.get(w, 0) + 0.5)) for w in range(words)])


class Scanner:
    """Templates as codes of words, each with its anchor, for files given by the places of their licence words."""

    def __init__(self, templates: list[Template], vocab: list[str], idf: np.ndarray):
        number = {w: i for i, w in enumerate(vocab)}
        self.templates, self.codes, self.spans, self.anchor = templates, [], [], []
        for t in templates:
            codes, spans = np.array([number[w] for w in t.words]), t.spans()
            first, end = spans[0]
            self.codes.append(codes)
            self.spans.append(spans)
            self.anchor.append(first + int(np.argmax(idf[codes[first:end]])))

    def places(self, row: np.ndarray, place: np.ndarray, code: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each template: its number, and row, place and share of each start where its phrases stand."""
        most = max(len(c) for c in self.codes)
        width = int(place.max(initial=0)) + 2 * most + 2
        where = row * width + place + most  # one line for all rows, with gaps wider than any template
        order = np.argsort(code, kind="stable")
        postings = np.split(where[order], np.searchsorted(code[order], np.arange(1, 1 + max(int(c.max()) for c in self.codes))))

        def has(c: int, at: np.ndarray) -> np.ndarray:
            own = postings[c]
            return own[np.minimum(np.searchsorted(own, at), len(own) - 1)] == at if len(own) else np.zeros(len(at), bool)

        for i, codes in enumerate(self.codes):
            start = postings[codes[self.anchor[i]]] - self.anchor[i]
            for q in (q for lo, hi in self.spans[i] for q in range(lo, hi)):
                start = start[has(codes[q], start + q)]
            found = sum((has(c, start + q).astype(np.int64) for q, c in enumerate(codes)), np.zeros(len(start), np.int64))
            first = self.spans[i][0][0]
            yield i, start // width, start % width - most + first, found / len(codes)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[Template] | None = None) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) for each row of docs; matches are the labels' places: label, word, share."""
    templates = TEMPLATES if templates is None else templates
    vocab = vocabulary(templates)
    index = index_files(docs, vocab, key, text)
    scanner = Scanner(templates, vocab, idf_of(index, len(vocab)))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)])
    for name, kind in (("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double")):
        schema = schema.add(name, kind)
    schema = schema.add("matches", T.ArrayType(T.StructType().add("label", "string").add("word", "long").add("share", "double")))
    match_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("share", pa.float64())]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, body in zip(batch.column("keys"), batch.column("body"), strict=True):
                sizes, counts, places, codes = unsqueeze(body.as_py())
                n = len(sizes)
                base, first, last, score = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1), np.zeros(n)
                base_labels, labels, matches = ([[] for _ in range(n)] for _ in range(3))
                for i, rows, at, share in scanner.places(np.repeat(np.arange(n), counts), places.astype(np.int64), codes):
                    t = templates[i]
                    keep = share >= t.share
                    rows, at, share = rows[keep], at[keep], share[keep]
                    if t.base:
                        base += np.bincount(rows, minlength=n)
                        np.minimum.at(first, rows, at)
                        np.maximum.at(last, rows, at)
                    np.maximum.at(score, rows, share)
                    for r, a, s in zip(rows.tolist(), at.tolist(), share.tolist(), strict=True):
                        matches[r].append({"label": t.label, "word": a, "share": s})
                    for r in set(rows.tolist()):
                        labels[r].append(t.label)
                        if t.base:
                            base_labels[r].append(t.label)
                text_of = lambda some: pa.array([",".join(sorted(set(x))) for x in some], pa.string())
                none = base == 0
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(sizes), pa.array(base), pa.array(first, mask=none), pa.array(last, mask=none), text_of(base_labels), text_of(labels), pa.array(score), pa.array(matches, match_type)], schema.names)

    return index.mapInArrow(run, schema)


def places_sql(templates: list[Template] | None = None) -> str:
    """The same rows as DuckDB SQL, by trying every place of every text."""
    templates = TEMPLATES if templates is None else templates
    rows = []
    for i, t in enumerate(templates):
        w = "[" + ", ".join(f"'{x}'" for x in t.words) + "]"
        must = "[" + ", ".join(str(q) for lo, hi in t.spans() for q in range(lo, hi)) + "]"
        rows.append(f"({i}, '{t.label}', {w}, {must}, {t.share!r}, {str(t.base).lower()}, {t.spans()[0][0]})")
    return r"""
with t(i, label, w, must, least, base, first) as (values """ + ",\n  ".join(rows) + r"""),
d as (select row_number() over () id, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') ws from documents),
p as (select id, ws, t.*, unnest(range(1, len(ws) + 1)) - first s from d join t on list_has_all(ws, list_transform(must, lambda q: w[q + 1]))),
m as (select id, label, base, s + first - 1 word, least, list_sum(list_transform(range(0, len(w)), lambda q: case when s + q >= 1 and ws[s + q] = w[q + 1] then 1 else 0 end)) / cast(len(w) as double) share
  from p where list_bool_and(list_transform(must, lambda q: coalesce(ws[s + q] = w[q + 1], false)))),
a as (select id, count(*) filter (base) n_base, min(word) filter (base) first_word, max(word) filter (base) last_word, max(share) score,
  coalesce(string_agg(distinct label, ',' order by label) filter (base), '') base_labels, coalesce(string_agg(distinct label, ',' order by label), '') labels from m where share >= least group by id)
select doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(n_base, 0) as bigint) n_base, cast(first_word as bigint) first_word, cast(last_word as bigint) last_word,
  coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0e0) score from d left join a using (id)
"""
