"""Exact token counts at every prefix, by prefix dynamic programming over byte pairs.

A byte-level BPE encoding of a prefix is one token longer than the encoding of a shorter prefix. For each
prefix of a pre-token, exactly one vocabulary token can end it: the one whose pair with the last token of
the remaining prefix is *compatible*, meaning that encoding their joined bytes gives the same two tokens.
So one left-to-right table gives the count at every byte, in time linear in the text, and truncation and
budget questions read the table instead of encoding again.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import Generations, map_whole_rows, small_batches, spread

#: Fixed value: the pre-token pattern of this family of byte-level vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts that are counted whole: doubled, leading or trailing white space, other white space or controls, special strings.
HARD = r"[ \n]{2}|^[ \n]|[ \n]$|[\x00-\x09\x0b-\x1f\x7f-\x{a0}\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]|<\|"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies, by their rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Counts for one vocabulary file (tokenizers' JSON, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        as_bytes = lambda t: bytes(letters[c] for c in t)
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.ranks: dict[tuple[int, int], int] = {}
        #: of each merged token: the rank of its merge and its two parts
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = map(as_bytes, m if isinstance(m, list) else m.split(" "))
            left, right = self.ids[a], self.ids[b]
            self.ranks[left, right] = rank
            self.made.setdefault(self.ids[a + b], (rank, left, right))
        self._ends = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self._ends.add_word(token.decode("latin-1"), (i, len(token)))
        self._ends.make_automaton()
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self._special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self._pretoken = regex.compile(PRETOKEN)
        self._pairs: dict[int, bool] = {}
        self._spines: tuple[dict, dict] = ({}, {})
        self._chunks = Generations(lambda chunks: [self._chunk_count(c) for c in chunks])

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens along a token's left (1) or right (2) edge, each with the rank of the merge that uses it up."""
        known = self._spines[side - 1].get(token)
        if known is None:
            known, at, used = [], token, float("inf")
            while True:
                known.append((at, used))
                if at not in self.made:
                    break
                used, at = self.made[at][0], self.made[at][side]
            self._spines[side - 1][token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether right may follow left: no merge across their seam comes before both are complete.

        Two edge tokens meet while neither is used up; their own merge must then not be the next one.
        At equal ranks the merge further left goes first.
        """
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            ranks = self.ranks
            known = self._pairs[key] = not any(
                (rank := ranks.get((a, b))) is not None and rank < used_a and rank <= used_b
                for a, used_a in self._spine(left, 2)
                for b, used_b in self._spine(right, 1)
            )
        return known

    def table(self, piece: str) -> list[int]:
        """Token counts of all byte prefixes of a pre-token; entry 0 is 0."""
        data = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        counts, last = [0] * (len(data) + 1), [-1] * (len(data) + 1)
        compatible, pairs = self.compatible, self._pairs
        for end, (token, length) in self._ends.iter(data):  # at each end the longest token first
            end += 1
            if last[end] < 0:
                start = end - length
                if start:
                    ok = pairs.get(last[start] << 32 | token)
                    if ok is None:
                        ok = compatible(last[start], token)
                else:
                    ok = True
                if ok:
                    last[end], counts[end] = token, counts[start] + 1
        return counts

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if self._special is None or "<" not in text:
            return self._count_plain(text)
        parts = self._special.split(text)
        return sum(map(self._count_plain, parts)) + len(parts) - 1

    def _count_plain(self, text: str) -> int:
        return sum(self.table(p)[-1] for p in self._pretoken.findall(text))

    def _chunk_count(self, chunk: str) -> int:
        """Of a chunk that follows a space, or that begins with the line feed it follows."""
        if chunk[:1] == "\n":
            return self._count_plain("\n") + self._count_plain(chunk[1:])
        return self._count_plain(" " + chunk)

    def count_batch(self, texts: pa.Array, budget: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text, and the code points of its longest prefix of at most `budget` tokens.

        No pre-token crosses a single space or line feed between two visible characters, so such texts are counted
        chunk by chunk, each different chunk once; running totals over the chunks are the counts of the prefixes that
        end with them, and the table of the chunk in which the budget ends has the rest. Other texts go whole.
        """
        hard = pc.match_substring_regex(texts, HARD).to_numpy(zero_copy_only=False)
        out, fit = np.zeros(len(texts), np.int64), pc.utf8_length(texts).to_numpy().astype(np.int64)
        for i in np.flatnonzero(hard):
            text = texts[int(i)].as_py()
            out[i] = self.count(text)
            if out[i] > budget:
                fit[i] = self.index(text).truncate(budget)
        easy = np.flatnonzero(~hard)
        lists = pc.split_pattern(pc.replace_substring(texts.take(pa.array(easy)), "\n", " \n"), " ")
        if not len(easy):
            return out, fit
        starts = lists.offsets.to_numpy()[:-1]
        coded = lists.flatten().dictionary_encode()
        which, chunks = coded.indices.to_numpy(), coded.dictionary
        counts = np.array(self._chunks.many(chunks.to_pylist()), np.int64)[which]
        firsts = [self._count_plain(c) for c in coded.take(pa.array(starts)).dictionary_decode().to_pylist()]
        counts[starts] = firsts
        out[easy] = np.add.reduceat(counts, starts)
        lengths = (pc.utf8_length(chunks).to_numpy() + ~pc.starts_with(chunks, "\n").to_numpy(zero_copy_only=False))[which]
        ends = np.r_[starts[1:], len(counts)]
        for i, a, z in zip(easy.tolist(), starts.tolist(), ends.tolist(), strict=True):
            if out[i] > budget:
                totals = np.cumsum(counts[a:z])
                k = int(np.searchsorted(totals, budget, "right"))
                before = int(totals[k - 1]) if k else 0
                chunk = chunks[int(which[a + k])].as_py()
                rest = self.index(chunk if not k or chunk[:1] == "\n" else f" {chunk}")
                at = int(lengths[a : a + k].sum()) - (k > 0)  # no space before the first chunk
                fit[i] = at + next(n for n in range(len(rest.text), -1, -1) if before + rest.count(n) <= budget)
        return out, fit

    def index(self, text: str) -> PrefixIndex:
        return PrefixIndex(self, text)


class PrefixIndex:
    """The stored table of one text: count(i) for every code-point prefix, truncate(budget), fits(budget)."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        self.starts: list[int] = []
        self.before: list[int] = []
        self.tables: list[list[int] | None] = []
        at = total = 0
        spans = [(m.start(), m.end()) for m in counter._special.finditer(text)] if counter._special else []
        for lo, hi in [*spans, (len(text), len(text))]:
            for m in counter._pretoken.finditer(text[at:lo]):
                table = counter.table(m[0])
                self.starts.append(at + m.start())
                self.before.append(total)
                self.tables.append(table)
                total += table[-1]
            if hi > lo:
                self.starts.append(lo)
                self.before.append(total)
                self.tables.append(None)
                total += 1
            at = hi
        self.total = total

    def count(self, i: int) -> int:
        """Tokens of text[:i] as the vocabulary's own library counts that prefix."""
        if i >= len(self.text):
            return self.total
        if i <= 0:
            return 0
        j = bisect_right(self.starts, i) - 1
        start = self.starts[j]
        if i == start and (j == 0 or self.tables[j] is None or not self.text[start - 1].isspace()):
            return self.before[j]
        head = self.text[start:i]
        if self.tables[j] is not None and i - start >= 2 and head[0] != "'" and not head.isspace():
            return self.before[j] + self.tables[j][len(head.encode("utf-8", "surrogatepass"))]
        k = max(0, j - 2)  # a cut can only rejoin what stands directly before it
        while k and self.tables[k] is None:
            k -= 1
        return self.before[k] + self.counter.count(self.text[self.starts[k] : i])

    def truncate(self, budget: int) -> int:
        """The length of the longest prefix with at most budget tokens."""
        if self.total <= budget:
            return len(self.text)
        j = bisect_right(self.before, budget) - 1
        ends = [*self.starts[1:], len(self.text)]
        for i in range(ends[min(j + 2, len(ends) - 1)], max(self.starts[max(0, j)] - 1, -1), -1):
            if self.count(i) <= budget:
                return i
        return 0

    def fits(self, budget: int) -> bool:
        return self.total <= budget


@lru_cache(maxsize=4)
def counter_for(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit, fit_chars.

    fit_chars is the length, in code points, of the longest prefix with at most `limit` tokens, read from the prefix
    tables. vocabulary is a file's place on every machine. A null text counts as empty; other columns are ignored,
    repeated rows give repeated results, an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(vocabulary)
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            tokens, fit = counter.count_batch(texts, limit)
            columns = [
                batch.column("doc_id").cast(pa.int64()), pc.binary_length(texts).cast(pa.int64()), pa.array(tokens, pa.int64()),
                pa.array(tokens > limit, pa.bool_()), pa.array(fit, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    return spread(docs.select("doc_id", "text")).mapInArrow(run, schema)


def truncate_texts(docs: DataFrame, vocabulary: str, budget: int) -> DataFrame:
    """The documents with texts cut to their longest prefix of at most `budget` tokens.

    All rows and columns stay; a null text stays null, an empty one empty; an empty table stays empty.
    """
    small_batches(docs.sparkSession)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").cast(pa.large_string())
        _, fit = counter_for(vocabulary).count_batch(pc.fill_null(texts, ""), budget)
        kept = [None if t is None else t[:n] for t, n in zip(texts.to_pylist(), fit.tolist(), strict=True)]
        return batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(kept, pa.string()))

    return map_whole_rows(spread(docs), cut)
