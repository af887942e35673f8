"""Token counts of whole texts as a public byte-level BPE gives them.

A huge text is encoded in overlapping chunks with offsets. Neighbouring chunks
are spliced where both start a pre-token: merges never cross such a place, and
what the pre-tokenizer finds from there on depends only on what follows, so it
is where the encoding of the whole text has a boundary, too. If an overlap has
no such place it is widened, and at last the chunk itself.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.llm.common import add_columns, id_text, pieces_of, texts_of, worker_cache

#: Texts of more characters are encoded in chunks.
CHUNK, OVERLAP = 65_536, 1_024
#: A place so near a chunk's end may look different with the rest of the text: a longer special token, a look ahead.
GUARD = 32
#: Pieces of which the counts are kept in a Python worker, and their longest.
MEMO, MEMO_CHARS = 300_000, 48

#: A blank is a clean cut if no other white space touches it: then the piece after it, blank included, is
#: pre-tokenized alike with or without what stands before.
UNCLEAN = re.compile(r"^ | $| \s|\s ")
CLEAN_CUT = re.compile(r"(?<=\S) (?=\S)")


class Chunk:
    """Encoding of text[start:end]: where its pre-tokens start, and how many tokens stand before each."""

    def __init__(self, tokenizer, text: str, start: int, end: int):
        found = tokenizer.encode(text[start:end], add_special_tokens=False)
        self.start, self.end, self.tokens = start, end, len(found)
        self.places, self.before, last = [], [], None
        for k, (word, (a, _)) in enumerate(zip(found.word_ids, found.offsets)):
            if word != last or word is None:
                self.places.append(start + a)
                self.before.append(k)
            last = word

    def tokens_before(self, place: int) -> int:
        k = bisect_left(self.places, place)
        if k == len(self.places) or self.places[k] != place:
            raise ValueError("no pre-token starts there")
        return self.before[k]

    def common(self, other: "Chunk", after: int) -> int | None:
        """The first place beyond ``after`` where both start a pre-token and this chunk's end is far enough."""
        theirs = set(other.places)
        last = self.end - GUARD
        return next((p for p in self.places[bisect_left(self.places, after + 1) :] if p <= last and p in theirs), None)


def count_spliced(tokenizer, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """Tokens of a whole text, encoded in chunks of ``size`` characters, and how often an overlap was widened."""
    if len(text) <= size:
        return len(tokenizer.encode(text, add_special_tokens=False)), 0
    left, cut, total, widened = Chunk(tokenizer, text, 0, size), 0, 0, 0
    while left.end < len(text):
        over = overlap
        while True:
            start = max(cut, left.end - over)
            right = Chunk(tokenizer, text, start, min(len(text), max(start + size, left.end + over)))
            place = left.common(right, cut)
            if place is not None or start == cut:
                break
            over, widened = 2 * over, widened + 1
        if place is None:  # no place in all of the chunk: take a longer one from the last proven place
            widened += 1
            left = Chunk(tokenizer, text, cut, min(len(text), cut + 2 * (left.end - cut)))
            continue
        total += left.tokens_before(place) - left.tokens_before(cut)
        left, cut = right, place
    return total + left.tokens - left.tokens_before(cut), widened


def pieces(text: str) -> list[str]:
    """The parts of a text between clean cuts; each but the first has lost the blank before it."""
    return CLEAN_CUT.split(text) if UNCLEAN.search(text) else text.split(" ")


class Counter:
    """Counts tokens of many texts; the counts of frequent pieces are kept, within bounds."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.memo: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for some in pieces_of(texts, 1 << 16):
            out += map(len, self.tokenizer.encode_batch_fast(some, add_special_tokens=False))
        return out

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(tokens, widened overlaps) of each text."""
        out = []
        for some in pieces_of(texts, 1 << 20):
            out += self._count(some)
        return out

    def _count(self, texts: list[str]) -> list[tuple[int, int]]:
        split = [pieces(t) if len(t) <= self.chunk else [] for t in texts]
        unknown: set[str] = set()
        for own in split:
            unknown.update(own[1:])
        unknown.difference_update(self.memo)
        if len(self.memo) + len(unknown) > MEMO:
            self.memo = {}
            unknown = {p for own in split for p in own[1:]}
        order = list(unknown)
        self.memo.update(zip(order, self.lengths([" " + p for p in order])))
        first = self.lengths([own[0] if own else "" for own in split])
        out = []
        for text, own, n in zip(texts, split, first):
            if own:
                out.append((n + sum(map(self.memo.__getitem__, own[1:])), 0))
            else:
                out.append(count_spliced(self.tokenizer, text, self.chunk, self.overlap))
        for p in order:
            if len(p) > MEMO_CHARS:
                del self.memo[p]
        return out


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Bytes and tokens of every whole text; one row for each input row.

    ``tokenizer_path`` names a byte-level BPE file of the ``tokenizers`` library that every executor can read.
    No begin, end or other added token counts; a special token's string inside a text is handled as the library
    does by default. Texts of more than ``chunk`` characters are spliced from chunks.

    Result: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``) and n_widened (overlaps that had to
    be widened). Null and empty texts have 0 bytes and tokens; a null id stays null; repeated rows give repeated
    results. Other columns are not read, whatever they are called. No row gives no row.

    No shuffle. A task holds one Arrow batch and one chunk's encoding, its worker the tokenizer and at most MEMO counts.
    """
    if not 0 < overlap < chunk:
        raise ValueError("the overlap is shorter than a chunk")

    key = ("counts", tokenizer_path, chunk, overlap)

    def make():
        counter = worker_cache(key, lambda: Counter(tokenizer_path, chunk, overlap))

        def new(batch):
            counts = [c for texts in texts_of(batch, "text") for c in counter.count(texts)]
            return [pa.array([c for c, _ in counts], pa.int64()), pa.array([w for _, w in counts], pa.int64())]

        return new

    counted = add_columns(id_text(docs, id_col, text_col), "n_tokens long, n_widened long", make, cache=key)
    return counted.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
        "n_widened",
    )
