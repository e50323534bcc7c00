"""License scans: an exact set-similarity join of text blocks with license templates.

A *block* is a run of words, twice as long as the blocks' overlap; any ``overlap + 1`` consecutive words lie in one block.
The overlap follows the template's length, so notices and whole licence texts of any length are templates.  A block meets a
template if it holds at least ``threshold`` of the template's distinct words (containment).  The join is exact: tokens are
ordered by their frequency in the whole corpus, and prefix, length and positional filters only discard blocks that cannot
meet the threshold.  The templates are a bounded parameter, so their index travels with the task and no text is shuffled.

Edge cases: null and empty texts have no words, no places, null first and last word, empty labels and score 0; very long
texts are cut into blocks whole; a block that meets several templates gives all their labels, and the score is the largest
containment; repeated rows each give their row; a null doc_id stays null; an empty table gives an empty result; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, id_of, slices, text_of

#: The base phrases and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: License notices that the method adds to the base phrases, by label (well-known public wording).
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "apache": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "mpl": "this source code form is subject to the terms of the mozilla public license",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "apache-2.0": "licensed under the apache license version 2 0",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
}
#: Whole licence texts (public wording), each under the label that its notice has too.
LICENSES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is "
        "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors "
        "or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or "
        "other dealings in the software"
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in "
        "all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall "
        "the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or "
        "other tortious action arising out of or in connection with the use or performance of this software"
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above "
        "copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties "
        "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
    ),
}
#: The least overlap of blocks, and the step in which it grows with a template's length.
OVERLAP, THRESHOLD = 32, 0.8

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOUND = "struct<label:string, template:string, exact:boolean, block_start:long, containment:double, places:array<long>>"


@dataclass(frozen=True)
class Template:
    """``exact``: a phrase, whose candidates are checked for consecutive words; otherwise a notice."""

    label: str
    words: tuple[bytes, ...]
    exact: bool

    @property
    def distinct(self) -> frozenset[bytes]:
        return frozenset(self.words)

    @property
    def overlap(self) -> int:
        """Overlap of the blocks that are compared with the template: at least its words, less one."""
        return OVERLAP * max(1, -(-(len(self.words) - 1) // OVERLAP))


def words_of(text: str) -> list[bytes]:
    """Words of a text whose A-Z are lower-cased; other characters stay as they are."""
    return WORD.findall(text.encode("utf-8").lower())


def templates(base: dict[str, str] = BASE_PHRASES, *notices: dict[str, str]) -> list[Template]:
    """Phrases (text: label) and notices of any length (label: text); without notices, those of this module."""
    made = [Template(label, tuple(words_of(t)), True) for t, label in base.items()]
    made += [Template(label, tuple(words_of(t)), False) for table in notices or (NOTICES, LICENSES) for label, t in table.items()]
    if any(not t.words for t in made):
        raise ValueError("a template has one word at least")
    return made


def token_frequencies(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """In how many documents of the whole corpus each template word occurs.  Bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = dict.fromkeys(vocabulary, 0)
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                for word in vocabulary.intersection(words_of(text)):
                    found[word] += 1
        yield batch_of(word=pa.array(found.keys(), pa.binary()), n=pa.array(found.values(), pa.int64()))

    counts = docs.select(text_of(text_col).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {word: 0 for word in vocabulary} | {bytes(r["word"]): r["n"] for r in counts.collect()}


class TemplateIndex:
    """Prefix index of the templates in ascending global frequency."""

    def __init__(self, made: list[Template], frequency: dict[bytes, int], threshold: float = THRESHOLD):
        self.templates, self.threshold = made, threshold
        order = sorted(frequency, key=lambda w: (frequency[w], w))
        self.rank = {word: at for at, word in enumerate(order)}
        self.ordered = [sorted(self.rank[w] for w in t.distinct) for t in made]
        #: smallest overlap that meets the threshold, free of rounding errors
        self.needs = [next(k for k in range(1, len(o) + 1) if k / len(o) >= threshold - 1e-12) for o in self.ordered]
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for at, (ranks, need) in enumerate(zip(self.ordered, self.needs)):
            for position, rank in enumerate(ranks[: len(ranks) - need + 1]):
                self.prefix.setdefault(order[rank], []).append((at, position))
        self.prefix_words = frozenset(self.prefix)

    def matches(self, words: list[bytes], overlap: int = OVERLAP) -> Iterator[tuple[int, int, float]]:
        """(template, block start, containment) of every block that meets its template's threshold."""
        if self.prefix_words.isdisjoint(words):
            return
        block_words, step = 2 * overlap, overlap
        last_block = max(0, -(-(len(words) - block_words) // step))
        blocks: set[int] = set()
        for at, word in enumerate(words):
            if word in self.prefix_words:
                blocks.update(range(max(0, -(-(at - block_words + 1) // step)), min(at // step, last_block) + 1))
        for block in sorted(blocks):
            held = sorted({self.rank[w] for w in words[block * step : block * step + block_words] if w in self.rank})
            place = {rank: at for at, rank in enumerate(held)}
            tried: set[int] = set()
            for word_rank in held:
                for at, position in self.prefix.get(self._word(word_rank), ()):
                    ranks, need = self.ordered[at], self.needs[at]
                    if at in tried or len(held) < need:  # length filter
                        continue
                    # positional filter: this word and what can still follow it on both sides
                    possible = sum(r in place for r in ranks[:position]) + 1 + min(len(ranks) - position - 1, len(held) - place[word_rank] - 1)
                    if possible < need:
                        continue
                    tried.add(at)
                    shared = sum(r in place for r in ranks)
                    if shared >= need:
                        yield at, block * step, shared / len(ranks)

    def _word(self, rank: int) -> bytes:
        if not hasattr(self, "_words"):
            self._words = sorted(self.rank, key=self.rank.__getitem__)
        return self._words[rank]


def places_of(words: list[bytes], phrase: tuple[bytes, ...], start: int, end: int) -> list[int]:
    """Starts in ``words[start:end]`` where the phrase's words stand one after another."""
    found, first, n = [], phrase[0], len(phrase)
    for at in range(start, min(end, len(words)) - n + 1):
        if words[at] == first and tuple(words[at : at + n]) == phrase:
            found.append(at)
    return found


def scan(docs: DataFrame, made: list[Template] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, found``, with a struct in ``found`` for every block that meets a template.

    For an exact template, ``places`` are the starts (word numbers) at which the phrase stands in that block.
    """
    made = made or templates()
    frequency = token_frequencies(docs, frozenset(w for t in made for w in t.words), text_col)
    indexes = [(overlap, TemplateIndex([t for t in made if t.overlap == overlap], frequency, threshold)) for overlap in sorted({t.overlap for t in made})]

    def run(part: pa.RecordBatch) -> tuple[list, list]:
        n_words, found = [], []
        for text in part.column(1).to_pylist():
            words = words_of(text)
            n_words.append(len(words))
            rows = []
            for overlap, index in indexes:
                for at, start, share in index.matches(words, overlap):
                    t = index.templates[at]
                    places = places_of(words, t.words, start, start + 2 * overlap) if t.exact else []
                    rows.append({"label": t.label, "template": b" ".join(t.words).decode(), "exact": t.exact, "block_start": start, "containment": share, "places": places})
            found.append(rows)
        return n_words, found

    kind = pa.list_(pa.struct([("label", pa.string()), ("template", pa.string()), ("exact", pa.bool_()), ("block_start", pa.int64()), ("containment", pa.float64()), ("places", pa.list_(pa.int64()))]))

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(given):
            n_words, found = run(part)
            yield batch_of(doc_id=part.column(0), n_words=pa.array(n_words, pa.int64()), found=pa.array(found, kind))

    return docs.select(id_of(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(batches, f"doc_id long, n_words long, found array<{FOUND}>")


def digest(found: DataFrame) -> DataFrame:
    """Per document: places of the base phrases, labels and score (the largest containment of any block)."""
    places = F.expr("array_distinct(flatten(transform(filter(found, f -> f.exact), f -> transform(f.places, p -> named_struct('p', p, 't', f.template)))))")
    labelled = F.expr("array_distinct(transform(filter(found, f -> f.exact AND size(f.places) > 0), f -> f.label))")
    more = F.expr("array_distinct(transform(filter(found, f -> NOT f.exact), f -> f.label))")
    return found.select("doc_id", "n_words", places.alias("at"), labelled.alias("base"), more.alias("more"), F.expr("coalesce(array_max(transform(filter(found, f -> NOT f.exact OR size(f.places) > 0), f -> f.containment)), 0D)").alias("score")).select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.expr("array_min(transform(at, x -> x.p))").alias("first_word"),
        F.expr("array_max(transform(at, x -> x.p))").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "more")), ",").alias("labels"),
        "score",
    )


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
