"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as one symbol per byte, the last with the end-of-word mark. A heap holds the adjacent
pairs that have a rank; the lowest rank (leftmost first) is popped and merged in a doubly linked
list until no ranked pair is left. The count is the initial symbols minus the merges; identifiers
are never made. The library supplies normalisation and the split into words.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, map_texts

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
CACHE = 400_000  # entries a worker keeps; beyond, it starts anew


class MergeCounter:
    """Counts the tokens of texts for a byte-level BPE vocabulary with an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.special = [t["content"] for t in spec["added_tokens"]]
        lib = Tokenizer.from_file(path)
        self.normalize, self.split = lib.normalizer.normalize_str, lib.pre_tokenizer.pre_tokenize_str
        self.of_word: dict[str, int] = {}
        self.of_chunk: dict[bytes, int] = {}

    def merged(self, word: str) -> int:
        """Tokens of one word, by popping the lowest-rank adjacent pair again and again."""
        n = len(word)
        if n < 2:
            return n
        sym: list[str | None] = list(word)
        sym[-1] += self.suffix
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.ranks
        heap = [(ranks[p], i, *p) for i in range(n - 1) if (p := (sym[i], sym[i + 1])) in ranks]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # one side was merged meanwhile
            sym[i], sym[j] = a + b, None
            merges += 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (r, h, sym[h], sym[i]))
        return n - merges

    def chunk(self, raw: bytes) -> int:
        """Tokens of a run without ASCII white space; no token spans white space."""
        text, total = raw.decode("utf-8", "replace"), 0
        for word, _ in self.split(self.normalize(text)):
            n = self.of_word.get(word)
            if n is None:
                if len(self.of_word) >= CACHE:
                    self.of_word.clear()
                n = self.merged(word)
                if len(word) <= 64:
                    self.of_word[word] = n
            total += n
        return total

    def plain(self, raw: bytes) -> int:
        known, total = self.of_chunk, 0
        for c in raw.split():
            n = known.get(c)
            if n is None:
                if len(known) >= CACHE:
                    known.clear()
                n = self.chunk(c)
                if len(c) <= 64:
                    known[c] = n
            total += n
        return total

    def count(self, raw: bytes) -> int:
        """Tokens of a text; a special string inside it is one token, as the library has it by default."""
        total, parts = 0, [raw]
        for s in self.special:
            cut = [p.split(s.encode()) for p in parts]
            total += sum(len(c) - 1 for c in cut)
            parts = [p for c in cut for p in c]
        return total + sum(map(self.plain, parts))


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row; null text counts as empty (0 bytes, 0 tokens).

    Long texts are counted whole. Repeated rows each give a row with the same counts, an empty table none;
    the id, null or not, is carried and no other column is read. Just ``limit`` tokens are not over it.
    ``vocabulary`` is a path that every executor can open. One narrow stage, no shuffle.
    """

    def run(texts: list[bytes | None]) -> list[list]:
        c = counter(vocabulary)
        n = [c.count(t) if t else 0 for t in texts]
        return [[len(t or b"") for t in texts], n, [x > limit for x in n]]

    return map_texts(docs, {"doc_id": F.col(doc_id)}, "n_bytes bigint, n_tokens bigint, over_limit boolean", run, text)


def op3_token_count(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
