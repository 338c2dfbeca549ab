"""Token counts by rank-synchronous merging of ragged arrays.

The pieces (runs without white space) of a batch of texts that a task hasn't met are normalised and pre-tokenised as the
tokenizer file says, and their bytes become one ragged array of symbol ids. Each round finds for every sequence its
lowest-ranked neighbouring pair and merges that pair, from the left, in all sequences at once; sequences without a
known pair leave. The surviving symbols of a piece are its token count. Counts of pieces stay in a bounded cache.
No pre-token and no special string has white space in it, so a text's count is the sum over its pieces.

Defined results: null text counts as empty (0 bytes, 0 tokens); a null doc_id stays null; repeated rows are counted
each; a very long text is cut into its pieces like any other and counted whole; of pairs of equal rank, which are the same
pair at several places, the leftmost is merged first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from pixelspark.llm.common import text_slices, tokenizer_path

#: The separators that Python's \s has and the tokenizer's white space may not have; texts with them stay whole.
ODD_SPACE = re.compile("[\x1c-\x1f]")


class RankMerger:
    """Counts tokens of word-end BPE files (NFC, lower case, word split, byte symbols, end-of-word suffix)."""

    def __init__(self, path: str, cache: int = 300_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.limit, self.known = spec["model"], cache, {}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"] + r"|\n")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"] if t["special"]) or r"(?!)")
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]  # bytes that stand for themselves
        hidden = [c for c in range(256) if c not in set(shown)]
        as_char = {c: chr(c) for c in shown} | {c: chr(256 + k) for k, c in enumerate(hidden)}
        self.inner = np.array([vocab[as_char[c]] for c in range(256)], np.int64)
        self.final = np.array([vocab[as_char[c] + suffix] for c in range(256)], np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank

    def pre_tokens(self, pieces: list[str]) -> tuple[list[str], list[int]]:
        """The pre-tokens of all pieces, and how many each piece has. One pass: a line break ends a piece."""
        text = unicodedata.normalize("NFC", "\n".join(pieces)).replace("Σ", "σ").lower()  # sigma: by character, not by word
        found = self.words.findall(text)
        breaks = [k for k, w in enumerate(found) if w == "\n"]
        counts = np.diff([-1, *breaks, len(found)]) - 1
        return [w for w in found if w != "\n"], counts.tolist()

    def merged(self, words: list[bytes]) -> np.ndarray:
        """Symbols that are left of each non-empty word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        owner = np.repeat(np.arange(len(words)), sizes)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.final[raw[ends]]
        left = sizes.copy()
        none = len(self.made)
        while len(symbols) > 1:
            pair = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            lowest = np.full(len(words), none)
            np.minimum.at(lowest, owner[:-1], rank)
            hit = np.flatnonzero((rank < none) & (rank == lowest[owner[:-1]]))
            if not len(hit):
                break
            # of overlapping hits (a run of neighbours) every second one counts, from the left
            run = np.cumsum(np.append(True, np.diff(hit) != 1))
            place = np.arange(len(hit)) - np.searchsorted(run, run, side="left")
            hit = hit[place % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            np.subtract.at(left, owner[hit], 1)
            stay = lowest[owner] < none
            stay[hit + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return left

    def learn(self, pieces: list[str]) -> None:
        parts, owner, special = [], [], [0] * len(pieces)
        for k, piece in enumerate(pieces):
            if "<" in piece or ODD_SPACE.search(piece):
                own = self.special.split(piece)
                special[k] = len(own) - 1
                for p in own:  # a whole text may still hold white space
                    parts += p.split("\n")
                    owner += [k] * (p.count("\n") + 1)
            else:
                parts.append(piece)
                owner.append(k)
        words, counts = self.pre_tokens(parts)
        left = self.merged([w.encode() for w in words]) if words else np.empty(0, np.int64)
        total = np.bincount(np.repeat(np.array(owner), counts), weights=left, minlength=len(pieces)).astype(np.int64)
        self.known.update(zip(pieces, (total + special).tolist(), strict=True))

    def __call__(self, texts: list[str | None]) -> list[int]:
        cut = [[] if not t else [t] if ODD_SPACE.search(t) else t.split() for t in texts]
        if len(self.known) > self.limit:
            self.known = {}
        new = list(set().union(*cut).difference(self.known))
        for at in range(0, len(new), 8192):
            self.learn(new[at : at + 8192])
        return [sum(map(self.known.__getitem__, pieces)) for pieces in cut]


@functools.cache
def rank_merger(path: str) -> RankMerger:
    """One for each Python worker, whose tasks share the cache."""
    return RankMerger(path)


def count_tokens(docs: DataFrame, limit: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; one narrow pass, no shuffle."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count = rank_merger(path)
        for batch in batches:
            tokens = [n for _, texts in text_slices(batch, 512) for n in count(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kept = docs.selectExpr("cast(doc_id as long) doc_id", "cast(coalesce(octet_length(text), 0) as long) n_bytes", "text")
    return kept.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
