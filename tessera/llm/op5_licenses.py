"""License scan by diagonal voting.

Every rolling word bigram of every text is joined with the bigrams of the license
templates.  A match at word p of the text and word o of a template votes for the
diagonal p - o; votes are counted by document, template and diagonal.  Neighbouring
diagonals are merged (a word put in or left out moves the rest of a text to the next
one), and each merged span is verified word by word.  A base phrase needs all its
bigrams on one diagonal, which is the same as its words standing there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHash, binary, pick, plain_words, rolling, slices

K = 2
#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Wording of common licenses and the labels that the method adds.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
           "documentation files the software to deal in the software without restriction",
    "mit-name": "released under the mit license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that "
           "the following conditions are met",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                  "general public license as published by the free software foundation",
    "lgpl": "gnu lesser general public license",
    "agpl": "gnu affero general public license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "cc by nc",
    "cc-by-sa": "cc by sa",
    "no-warranty": "the software is provided as is without warranty of any kind express or implied",
    # whole texts, from the first word of the grant to the last of the disclaimer
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                "documentation files the software to deal in the software without restriction including without limitation the "
                "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
                "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice "
                "and this permission notice shall be included in all copies or substantial portions of the software the software "
                "is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
                "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
                "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
                "arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
                "provided that the above copyright notice and this permission notice appear in all copies the software is provided "
                "as is and the author disclaims all warranties with regard to this software including all implied warranties of "
                "merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential "
                "damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
                "negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-2-clause-text": "redistribution and use in source and binary forms with or without modification are permitted provided that "
                         "the following conditions are met 1 redistributions of source code must retain the above copyright notice "
                         "this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the "
                         "above copyright notice this list of conditions and the following disclaimer in the documentation and or "
                         "other materials provided with the distribution this software is provided by the copyright holders and "
                         "contributors as is and any express or implied warranties including but not limited to the implied "
                         "warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache-2.0-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
                         "with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless "
                         "required by applicable law or agreed to in writing software distributed under the license is distributed "
                         "on an as is basis without warranties or conditions of any kind either express or implied see the license "
                         "for the specific language governing permissions and limitations under the license",
}
#: Bigrams of two such words are no evidence and give no vote.
COMMON = frozenset("a an and any as by for from in is it of on or that the this to use under with you".split())


def seeds(words: list[str], all_of_them: bool) -> list[int]:
    """Places of a template's bigrams that vote."""
    return [i for i in range(len(words) - K + 1) if all_of_them or not set(words[i:i + K]) <= COMMON]


def _templates() -> list[tuple[str, list[bytes], list[int], bool]]:
    out = [(label, p.encode().split(), seeds(p.split(), True), True) for p, label in BASE.items()]
    return out + [(label, p.encode().split(), seeds(p.split(), False), False) for label, p in TEMPLATES.items()]


def _hash(words: list[bytes]) -> np.ndarray:
    return rolling(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64), K).view(np.int64)


def template_rows(spark) -> DataFrame:
    """``(h, template, place)``: a row for each voting bigram, a few hundred in all."""
    rows = []
    for t, (_, words, at, _) in enumerate(_templates()):
        h = _hash(words)
        rows += [(int(h[i]), t, i) for i in at]
    return spark.createDataFrame(rows, "h long, template int, place int")


def bigram_rows(docs: DataFrame) -> DataFrame:
    """``(k1, k2, pos, h)``: every rolling word bigram of every whole text under the text's two hashes."""
    names = ["k1", "k2", "pos", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHash()
        for b in slices(batches, "text", 2 << 20):
            rows, pos, h = [], [], []
            for i, text in enumerate(binary(b.column("text")).to_pylist()):
                g = rolling(hashed(plain_words(text)), K)
                rows.append(np.full(len(g), i))
                pos.append(np.arange(len(g), dtype=np.int32))
                h.append(g)
            at = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(b.column(k).to_numpy()[at]) for k in ("k1", "k2")), pa.array(np.concatenate(pos)),
                 pa.array(np.concatenate(h).view(np.int64))], names=names)

    return docs.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, pos int, h long")


def merge_diagonals(votes: list[tuple[int, int, int, int]], slack: int) -> list[tuple[int, int, int]]:
    """Merge ``(diagonal, votes, first, last)`` of neighbouring diagonals into ``(votes, first, last)`` spans.

    A sweep by diagonal: a span that no diagonal within ``slack`` has touched is closed, so at most
    ``slack + 1`` spans are open.
    """
    out: list[list[int]] = []
    live: list[list[int]] = []
    for diagonal, n, lo, hi in sorted(votes):
        live = [s for s in live if diagonal - s[3] <= slack]
        for s in live:
            if lo <= s[2] + slack + K and hi >= s[1] - slack - K:
                s[0], s[1], s[2], s[3] = s[0] + n, min(s[1], lo), max(s[2], hi), diagonal
                break
        else:
            live.append([n, lo, hi, diagonal])
            out.append(live[-1])
    return [(n, lo, hi) for n, lo, hi, _ in out]


def coverage(span: list[bytes], template: list[bytes]) -> float:
    """Share of a template's words that stand in a span in the same order.

    The longest common subsequence, a bit a template word: a step a word of the span.
    """
    at: dict[bytes, int] = {}
    for j, w in enumerate(template):
        at[w] = at.get(w, 0) | 1 << j
    full = (1 << len(template)) - 1
    row = full
    for w in span:
        hit = row & at.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return (len(template) - row.bit_count()) / len(template)


def verify(words: list[bytes], votes: list[tuple[int, int, int, int, int]], least: float, slack: int = 3
           ) -> tuple[list[tuple[str, int, int, float]], list[tuple[str, int]]]:
    """Spans ``(label, start, end, coverage)`` of templates and places ``(label, start)`` of base phrases.

    ``votes`` holds ``(template, diagonal, votes, first, last)``.
    """
    all_t, spans, places = _templates(), [], []
    by: dict[int, list] = {}
    for t, *rest in votes:
        by.setdefault(t, []).append(tuple(rest))
    for t, found in by.items():
        label, words_t, at, base = all_t[t]
        if base:
            places += [(label, g) for g, n, _, _ in found if n == len(at) and words[g:g + len(words_t)] == words_t]
            continue
        for n, lo, hi in merge_diagonals(found, slack):
            if n < least * len(at) / 2:
                continue
            a, b = max(0, lo - at[0] - slack), min(len(words), hi + K + len(words_t) - at[-1] - K + slack)
            share = coverage(words[a:b], words_t)
            if share >= least:
                spans.append((label, lo, hi + K, share))
    return sorted(spans, key=lambda s: (s[1], s[0])), sorted(places, key=lambda p: (p[1], p[0]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.85) -> DataFrame:
    """``(doc_id, n_words, places, spans)``, one row per input row.

    ``places`` are the starts of base phrases with their labels, ``spans`` the template
    passages of which at least ``least`` of the words stand in order.  Null and empty texts
    have no words.  Votes belong to a text, named by two 64-bit hashes, not to an id: rows without an id or with a
    shared one are scanned on their own, and equal texts share their votes.
    """
    d = pick(docs, doc_id=id_col, text=text_col).select("*", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(K), "text").alias("k2"))
    # the template table has a few hundred fixed rows
    votes = (bigram_rows(d).join(F.broadcast(template_rows(docs.sparkSession)), "h")
             .groupBy("k1", "k2", "template", (F.col("pos") - F.col("place")).alias("diagonal"))
             .agg(F.count_distinct("pos").cast("int").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi")))
    # a diagonal with one vote of many is no candidate, but may lie beside one that is: kept by template and text
    per = (votes.groupBy("k1", "k2", "template").agg(F.sum("n").alias("total"),
                                                    F.collect_list(F.struct("template", "diagonal", "n", "lo", "hi")).alias("v")))
    need = F.lit(1)
    for t, (_, _, at, base) in enumerate(_templates()):
        need = F.when(F.col("template") == t, F.lit(len(at) if base else max(1.0, least * len(at) / 2))).otherwise(need)
    found = (per.where(F.col("total") >= need).groupBy("k1", "k2")
             .agg(F.flatten(F.collect_list("v")).alias("votes")))
    place = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType())])
    span = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()),
                         T.StructField("end", T.IntegerType()), T.StructField("coverage", T.DoubleType())])
    schema = T.StructType([T.StructField("doc_id", d.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("places", T.ArrayType(place)), T.StructField("spans", T.ArrayType(span))])
    p_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32())]))
    s_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("coverage", pa.float64())]))

    def run(batches):
        for b in slices(batches, "text", 8 << 20):
            n, places, spans = [], [], []
            for text, got in zip(binary(b.column("text")).to_pylist(), b.column("votes").to_pylist()):
                words = plain_words(text)
                s, p = verify(words, [(v["template"], v["diagonal"], v["n"], v["lo"], v["hi"]) for v in got], least) if got \
                    else ([], [])
                n.append(len(words))
                places.append([{"label": x, "start": a} for x, a in p])
                spans.append([{"label": x, "start": a, "end": e, "coverage": c} for x, a, e, c in s])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(places, p_type),
                                              pa.array(spans, s_type)], names=schema.names)

    return d.join(found, ["k1", "k2"], "left").select("doc_id", "text", "votes").mapInArrow(run, schema)


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, labels and score: 1 with a base phrase, else the best template coverage, else 0."""
    s = scan_licenses(docs, id_col, text_col)
    base = F.sort_array(F.array_distinct(F.col("places.label")))
    labels = F.sort_array(F.array_distinct(F.concat(F.col("places.label"), F.col("spans.label"))))
    return s.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
                    F.array_min("places.start").cast("long").alias("first_word"),
                    F.array_max("places.start").cast("long").alias("last_word"),
                    F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
                    F.round(F.when(F.size("places") > 0, F.lit(1.0)).otherwise(
                        F.coalesce(F.array_max("spans.coverage"), F.lit(0.0))), 6).alias("score"))
