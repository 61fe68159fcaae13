"""BPE encoding and decoding as streaming transducers of bounded memory.

The encoder never needs a whole word. Which merges apply left of a place depends on what follows it only through a
chain of merges, each of which joins the left neighbour of the one before. The longest such chain that the merge
list allows is the *sufficient lookahead*: a token that ends that many symbols before the end of what has been read
is final, whatever comes next, and is emitted.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from tokenizers import Tokenizer

from flowsift.llm.common import text_of, with_new
from flowsift.llm.tokens import byte_alphabet

#: Words remembered in one generation per Python worker, and symbols of the longest word that is remembered.
WORDS_KEPT = 200_000
SHORT = 48

#: Characters of a text that are normalised and split at a time; a longer stretch without white space is one segment.
SEGMENT = 1 << 16

#: Characters whose class, lower case and composition are the same in every Unicode version: up to Latin Extended-A,
#: and general punctuation. Of these, the spaces.
PLAIN = "".join(map(chr, [*range(0x180), *range(0x2000, 0x2060)]))
SPACES = "".join(c for c in PLAIN if c.isspace() and c not in "\x1c\x1d\x1e\x1f")


class MergeList:
    """Symbols, merges and special tokens of a BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in (self.ids | self.special).items()}
        stand_in = {b: c for c, b in byte_alphabet().items()}
        self.inner = [self.ids[stand_in[b]] for b in range(256)]
        self.final = [self.ids[stand_in[b] + self.suffix] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            pair, whole = (self.ids[left], self.ids[right]), self.ids[left + right]
            self.merges[pair] = (rank, whole)
            self.halves.setdefault(whole, pair)
        self.lookahead = self.sufficient_lookahead()

    def width(self, token: int) -> int:
        """Symbols, that is bytes, of a token."""
        text = self.tokens[token]
        return len(text) - len(self.suffix) if self.suffix and text.endswith(self.suffix) else len(text)

    def sufficient_lookahead(self) -> int:
        """Symbols by which the merges beyond a place can change the tokens before it, at most.

        Two texts agree up to a place. The boundary up to which their tokens agree moves left when a merge (u, v)
        joins across it in one text only, by the width of u. The next such merge (u', v') has a higher rank, and its
        v' begins where u began, so u is on the left edge of how v' was built. The longest path over merges in
        rank order is the bound.
        """
        reach: dict[int, int] = {}
        longest = 0
        for (left, right), (rank, _) in sorted(self.merges.items(), key=lambda item: item[1][0]):
            before, edge = 0, right
            while True:
                before = max(before, reach.get(edge, 0))
                if edge not in self.halves:
                    break
                edge = self.halves[edge][0]
            here = before + self.width(left)
            reach[left] = max(reach.get(left, 0), here)
            longest = max(longest, here)
        return longest

    def merge(self, symbols: list[int]) -> list[int]:
        """Tokens of a sequence of symbols: the merge of lowest rank first, leftmost among equals."""
        merges, count = self.merges, len(symbols)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        waiting = [(found[0], i, found[1]) for i in range(count - 1) if (found := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(waiting)
        while waiting:
            _, at, whole = heapq.heappop(waiting)
            right = after[at]
            if symbols[at] < 0 or right >= count or merges.get((symbols[at], symbols[right]), (0, -1))[1] != whole:
                continue  # one of the two has been merged meanwhile
            symbols[at], symbols[right] = whole, -1
            after[at] = following = after[right]
            if following < count:
                before[following] = at
                if found := merges.get((whole, symbols[following])):
                    heapq.heappush(waiting, (found[0], at, found[1]))
            if (previous := before[at]) >= 0 and (found := merges.get((symbols[previous], whole))):
                heapq.heappush(waiting, (found[0], previous, found[1]))
        return [s for s in symbols if s >= 0]


class WordTransducer:
    """Bytes of one word in, tokens out as soon as they are final. Holds at most four lookaheads of symbols."""

    def __init__(self, merges: MergeList, window: int = 0):
        self.merges = merges
        self.window = max(window, 2 * merges.lookahead + 2)
        self.held = bytearray()

    def push(self, data: bytes) -> Iterator[int]:
        for start in range(0, len(data), self.window):
            self.held += data[start : start + self.window]
            if len(self.held) > self.window:  # the last byte of the word is never merged as an inner one
                yield from self._final_tokens()

    def _final_tokens(self) -> Iterator[int]:
        merges, settled = self.merges, 0
        stable = len(self.held) - 1 - merges.lookahead
        for token in merges.merge([merges.inner[b] for b in self.held[:-1]]):
            width = merges.width(token)
            if settled + width > stable:
                break
            settled += width
            yield token
        del self.held[:settled]

    def finish(self) -> Iterator[int]:
        """The word ends here."""
        merges = self.merges
        if self.held:
            yield from merges.merge([merges.inner[b] for b in self.held[:-1]] + [merges.final[self.held[-1]]])
        self.held.clear()


class Encoder:
    """Whole texts to tokens, segment by segment."""

    def __init__(self, path: str):
        self.merges = MergeList(path)
        self.own = Tokenizer.from_file(path)
        self.marks = re.compile("(%s)" % "|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True))))
        kinds = {k: "".join(c for c in PLAIN if unicodedata.category(c)[0] == k) for k in "LN"}
        letters, numbers, space = (re.escape(x) for x in (kinds["L"], kinds["N"], SPACES))
        # the file's splitting pattern for plain characters; letters come first, as nothing else starts with one
        self.split = re.compile(f"[{letters}]+|[{numbers}]|'(?:[stmd]|re|ve|ll)|[^{space}{letters}{numbers}]+")
        self.segment_end = re.compile(f"[{space}]")
        self.unusual = re.compile(f"[^{re.escape(PLAIN)}]")
        self.alphabet = byte_alphabet()
        self.words: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def segments(self, text: str) -> Iterator[str]:
        """The text cut before white space, which neither composes with its neighbours nor is part of a word."""
        start = 0
        while start < len(text):
            cut = self.segment_end.search(text, min(len(text), start + SEGMENT))
            end = cut.start() if cut else len(text)
            yield text[start:end]
            start = end

    def split_words(self, segment: str) -> Iterator[str] | list[str]:
        """Words of a segment after the file's normaliser: composed, lower case, split by kind of character."""
        if self.unusual.search(segment):  # the library's own tables decide on the rest of Unicode
            pieces = self.own.pre_tokenizer.pre_tokenize_str(self.own.normalizer.normalize_str(segment))
            return [bytes(self.alphabet[c] for c in piece).decode("utf-8", "surrogateescape") for piece, _ in pieces]
        return self.split.findall(segment.lower())  # plain characters are composed already

    def word(self, word: str) -> list[int]:
        """Tokens of a word, remembered if it is short."""
        known = self.words.get(word) or self.older.get(word)
        if known is None:
            data = word.encode("utf-8", "surrogateescape")
            transducer = WordTransducer(self.merges)
            known = [*transducer.push(data), *transducer.finish()]
        if len(word) <= SHORT:
            if len(self.words) >= WORDS_KEPT:
                self.older, self.words = self.words, {}
            self.words[word] = known
        return known

    def encode(self, text: str) -> Iterator[list[int]]:
        """Lists of tokens whose chain is the encoding. Special tokens spelled out in the text count as such."""
        special, words = self.merges.special, self.words
        for segment in self.segments(text):
            for part in self.marks.split(segment) if "<|" in segment else (segment,):
                if part in special:
                    yield [special[part]]
                    continue
                out: list[int] = []
                for word in self.split_words(part):
                    known = words.get(word)
                    if known is None:
                        known, words = self.word(word), self.words
                    out += known
                    if len(out) > SEGMENT:
                        yield out
                        out = []
                if out:
                    yield out


class Decoder:
    """Tokens to text, piece by piece; keeps the bytes of one unfinished character.

    ``library`` gives what the file's library gives when the file names no decoder: the tokens as they are spelled in
    the vocabulary, one blank between two. Otherwise bytes are put together to characters and word ends to blanks.
    """

    def __init__(self, merges: MergeList, library: bool = False):
        self.merges, self.library, self.started = merges, library, False
        self.characters = codecs.getincrementaldecoder("utf-8")("replace")
        self.alphabet = byte_alphabet()

    def push(self, tokens: list[int]) -> str:
        spelled = self.merges.tokens
        if self.library:
            text = " ".join([spelled[t] for t in tokens if t in spelled])
            blank = " " if self.started and text else ""
            self.started = self.started or bool(text)
            return blank + text
        return "".join(map(self._text, tokens))

    def _text(self, token: int) -> str:
        spelled, suffix = self.merges.tokens.get(token, ""), self.merges.suffix
        if spelled in self.merges.special:
            return self.characters.decode(b"", True) + spelled
        ends = bool(suffix) and spelled.endswith(suffix)
        data = bytes(self.alphabet[c] for c in (spelled[: -len(suffix)] if ends else spelled))
        return self.characters.decode(data, ends) + (" " if ends else "")

    def finish(self) -> str:
        return self.characters.decode(b"", True)


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    return Encoder(path)


def encode_texts(df: DataFrame, tokenizer: str, column: str = "text") -> DataFrame:
    """Add ``ids``, the tokens of each text. A null text has none; an input column ``ids`` is replaced."""

    @arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        encoder = encoder_of(tokenizer)
        return pa.array([[i for part in encoder.encode(t.as_py()) for i in part] for t in texts], pa.list_(pa.int32()))

    return with_new(df, {"ids": encode(text_of(column))})


def decode_ids(df: DataFrame, tokenizer: str, column: str = "ids", library: bool = False) -> DataFrame:
    """Add ``decoded``, the text of each array of tokens; null or empty arrays give the empty text, unknown ids nothing."""

    @arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        merges = encoder_of(tokenizer).merges
        out = []
        for row in rows:
            decoder = Decoder(merges, library)
            out.append(decoder.push([i for i in row.as_py() or () if i is not None]) + decoder.finish())
        return pa.array(out, pa.string())

    return with_new(df, {"decoded": decode(F.col(column))})


def digest_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded as streams.

    Neither the tokens nor the decoded text of a document are ever held as a whole. A null text counts as empty:
    no tokens, and the digests of the empty text. Repeated rows are kept; nothing is shuffled.
    """

    @arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def digest(texts: pa.Array) -> pa.Array:
        encoder = encoder_of(tokenizer)
        decimal = {i: str(i) for i in encoder.merges.tokens}
        counts, ids_digests, text_digests = [], [], []
        for text in texts:
            ids_hash, text_hash, count = hashlib.sha256(), hashlib.sha256(), 0
            decoder = Decoder(encoder.merges, library=True)
            for part in encoder.encode(text.as_py()):
                ids_hash.update(((" " if count else "") + " ".join([decimal[i] for i in part])).encode())
                text_hash.update(decoder.push(part).encode())
                count += len(part)
            counts.append(count)
            ids_digests.append(ids_hash.hexdigest())
            text_digests.append(text_hash.hexdigest())
        kinds = [pa.array(counts, pa.int64()), pa.array(ids_digests), pa.array(text_digests)]
        return pa.StructArray.from_arrays(kinds, names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest(text_of()).alias("_d")).select("doc_id", "_d.*")
