"""Token counts by a unigram model whose forward scores live in a trie of pre-tokens.

Pieces are those of a byte-level vocabulary, which is given and not trained.  A piece's log-probability is estimated from the
documents: its share of all ids that the vocabulary's own encoding has in the whole corpus, each count raised by one.  The
best segmentation of a pre-token maximises the sum
of its pieces' log-probabilities; ties take fewer pieces.  Distinct pre-tokens are inserted in sorted order into a trie
whose nodes hold the best forward score and piece count of their prefix, so a shared prefix is scored once, and a
pre-token's count is read at its terminal node.

Scale: tasks add up their own piece counts and the driver gets one number a piece of the vocabulary, for any corpus.  A
trie belongs to a Python worker and is emptied beyond ``MOST_NODES``; nothing else is exchanged between tasks.

Edge cases: null and empty texts count 0; very long texts are split whole; repeated rows each give their row, and count in
the estimate each; equally likely segmentations take the one of fewer pieces; a null doc_id stays null; an empty table
gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, id_of, map_batches, summed, text_of
from .tokens import PLAIN, PRE_TOKEN, encoder, vocab_path

MOST_NODES, MOST_WORDS = 500_000, 250_000


def unigram_scores(pieces: list[bytes], counts: np.ndarray, skipped: frozenset[int] = frozenset()) -> dict[bytes, float]:
    """Log-probability of each piece from its count, raised by one so that none is impossible."""
    used = [at for at in range(len(pieces)) if at not in skipped and pieces[at]]
    total = math.log(sum(int(counts[at]) + 1 for at in used))
    return {pieces[at]: math.log(int(counts[at]) + 1) - total for at in used}


def piece_counts(docs: DataFrame, vocab: str | None = None, text_col: str = "text") -> np.ndarray:
    """How often each id occurs in the encoding of all texts."""
    vocab = vocab or vocab_path()
    size = len(encoder(vocab).pieces)

    def count(part: pa.RecordBatch) -> np.ndarray:
        bpe = encoder(vocab)
        return np.bincount(bpe.ids(b"".join(map(bpe.encode, part.column(0).to_pylist()))), minlength=size)

    return summed(docs.select(text_of(text_col).alias("text")), count, size)


class ForwardTrie:
    """Prefixes of pre-tokens with their forward score and piece count."""

    def __init__(self, scores: dict[bytes, float], most_nodes: int = MOST_NODES):
        self.scores, self.longest, self.most_nodes = scores, max(map(len, scores)), most_nodes
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.best, self.pieces = array("d", [0.0]), array("i", [0])

    def insert(self, word: bytes) -> int:
        """Number of pieces in the best segmentation of ``word``; only unseen prefixes are scored."""
        children, best, pieces, scores = self.children, self.best, self.pieces, self.scores
        path, node, depth = [0], 0, 0
        for byte in word:
            child = children.get(node << 8 | byte)
            if child is None:
                break
            path.append(child)
            node, depth = child, depth + 1
        for end in range(depth + 1, len(word) + 1):
            top, count = -math.inf, 0
            for start in range(max(0, end - self.longest), end):
                score = scores.get(word[start:end])
                if score is not None:
                    before = path[start]
                    score += best[before]
                    if score > top or (score == top and pieces[before] + 1 < count):
                        top, count = score, pieces[before] + 1
            child = len(best)
            children[node << 8 | word[end - 1]] = child
            best.append(top)
            pieces.append(count)
            path.append(child)
            node = child
        return pieces[node]


class UnigramCounter:
    def __init__(self, vocab: str, counts: bytes):
        self.bpe = encoder(vocab)
        added = frozenset(self.bpe.library.get_added_tokens_decoder())
        self.trie, self.known = ForwardTrie(unigram_scores(self.bpe.pieces, np.frombuffer(counts, dtype=np.int64), added)), {}
        import public_tokenizers
        import regex

        self.any_text = regex.compile(public_tokenizers.PATTERN)

    def split(self, text: str) -> list[str]:
        return PRE_TOKEN.findall(text) if PLAIN.fullmatch(text) else self.any_text.findall(text)

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        if len(self.trie.best) > MOST_NODES or len(self.known) > MOST_WORDS:
            self.trie.clear()
            self.known = {}
        words = [Counter(self.split(t)) for t in texts]
        unseen = set().union(*words).difference(self.known)
        for word in sorted(w.encode("utf-8") for w in unseen):
            self.known[word.decode("utf-8")] = self.trie.insert(word)
        return [(sum(c.values()), sum(n * self.known[w] for w, n in c.items())) for c in words]


@lru_cache(maxsize=1)
def counter(vocab: str, counts: bytes) -> UnigramCounter:
    """One counter per Python worker for the counts of a corpus."""
    return UnigramCounter(vocab, counts)


def count_tokens(docs: DataFrame, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_pretokens, n_tokens`` of every row."""
    vocab = vocab or vocab_path()
    known = piece_counts(docs, vocab, text_col).tobytes()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        counts = counter(vocab, known).count(part.column(1).to_pylist())
        return batch_of(doc_id=part.column(0), n_pretokens=pa.array([a for a, _ in counts], pa.int64()), n_tokens=pa.array([b for _, b in counts], pa.int64()))

    return map_batches(docs.select(id_of(id_col).alias("doc_id"), text_of(text_col).alias("text")), run, "doc_id long, n_pretokens long, n_tokens long")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
