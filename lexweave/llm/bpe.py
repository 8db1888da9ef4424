"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

Every piece of a text is matched once by an Aho-Corasick automaton that holds the vocabulary. The
encoder takes the longest token that starts where it stands, so long as the token and the one
before it are compatible: a table of merges tells whether merging the two tokens' parts would have
crossed their border. If not, it tries the next shorter token, and steps back when none is left.
Marks of positions that led nowhere keep the whole linear. The result is the one that applying the
merges in order gives.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import released, slices

#: Where the private symbols begin that stand for a word's last character.
ENDS = 0x100000
#: Chunks and pieces of text, and pairs of tokens, that a worker remembers in one generation. When it is full it becomes the old one, from which what is asked for again comes back; the one before is forgotten.
CACHE_CHUNKS = 200_000
#: Longer chunks are encoded without being remembered.
CACHE_CHUNK_CHARS = 64
#: Python splits at these too; to the tokenizer they are no white space.
NOT_SPACES = re.compile("[\x1c-\x1f]")
SPACE_RUN = re.compile("[\t-\r \x85\xa0  -     　]+")


#: Marks that are a piece by themselves behind letters.
PLAIN_MARKS = frozenset(".,;:!?)]}\"*&%$#")
#: Byte-level models write each byte as a printable character: those of Latin-1 as they are, the rest from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARACTERS = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Vocabulary:
    """Tokens, merges and their pair table, from the JSON text of a tokenizer file with a BPE model."""

    def __init__(self, source: str) -> None:
        import ahocorasick

        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = {self._symbols(t): i for t, i in model["vocab"].items()}
        self.texts: dict[int, str] = {i: t for t, i in model["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.pairs: dict[tuple[int, int], int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = self.ids[self._symbols(left, False)], self.ids[self._symbols(right)]
            token = self.ids[self._symbols(left, False) + self._symbols(right)]
            self.pairs[pair], self.merged[pair] = rank, token
            if token not in self.parts:
                self.parts[token], self.rank[token] = pair, rank
        self.added = re.compile("|".join(re.escape(a["content"]) for a in spec["added_tokens"])) if spec["added_tokens"] else None
        self.added_ids = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.matches = ahocorasick.Automaton()
        known = sorted(self.ids, key=len)
        #: Tokens that the merges make of their own symbols.
        self.usable = usable = {t: self.ids[t] for t in known if len(t) == 1 or self.merge_all(t) == [self.ids[t]]}
        for token in usable:
            self.matches.add_word(token, (self.ids[token], len(token)))
        self.matches.make_automaton()
        self.length = {i: len(t) for t, i in self.ids.items()}
        #: The longest usable token that is a proper prefix of a token, or -1.
        self.shorter: dict[int, int] = {}
        for token in usable:
            self.shorter[self.ids[token]] = next((self.ids[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in usable), -1)
        self._compatible: dict[int, bool] = {}

    def _symbols(self, token: str, last: bool = True) -> str:
        """One character for each symbol: a character with the end-of-word suffix is one symbol."""
        if self.suffix and last and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ENDS + ord(body[-1]))
        return token

    def merge_all(self, symbols: str) -> list[int]:
        """The ids by applying the merges in order; used to tell which tokens the merges can make."""
        ids = [self.ids[c] for c in symbols]
        while len(ids) > 1:
            rank, at = min((self.pairs.get((a, b), 1 << 60), k) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == 1 << 60:
                break
            ids[at : at + 2] = [self.merged[ids[at], ids[at + 1]]]
        return ids

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave the border between the two tokens alone."""
        key = left << 32 | right
        if (found := self._compatible.get(key)) is not None:
            return found
        limit = 1 << 60
        ranks, parts = self.rank, self.parts
        while True:
            if self.pairs.get((left, right), 1 << 60) < limit:
                good = False
                break
            a, b = ranks.get(left, -1), ranks.get(right, -1)
            if a < 0 and b < 0:
                good = True
                break
            if a > b:
                limit, left = a, parts[left][1]
            else:
                limit, right = b + 1, parts[right][0]
        if len(self._compatible) >= CACHE_CHUNKS:
            self._compatible.clear()
        self._compatible[key] = good
        return good

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one piece, given in the model's byte characters."""
        symbols = piece[:-1] + chr(ENDS + ord(piece[-1])) if self.suffix else piece
        if (whole := self.usable.get(symbols)) is not None:
            return [whole]
        n = len(symbols)
        longest = [-1] * (n + 1)
        for end, (token, size) in self.matches.iter(symbols):
            # matches come by their end, so the last one from a start is the longest
            longest[end - size + 1] = token
        out: list[int] = []
        dead = bytearray(n + 1)
        length, shorter, known, compatible = self.length, self.shorter, self._compatible, self.compatible
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if not dead[end]:
                    fits = last < 0 or known.get(last << 32 | token)
                    if fits or (fits is None and compatible(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, token = end, longest[end]
            else:
                if not out:
                    raise ValueError(f"no tokens for {piece!r}")
                dead[at] = 1
                back = out.pop()
                at -= length[back]
                token = shorter[back]
        return out


class OffsetTable:
    """Decoding: the tokens' texts end to end, each with a space after it, and where each begins."""

    def __init__(self, texts: dict[int, str]) -> None:
        parts = [(texts.get(i, "") + " ").encode() for i in range(max(texts, default=-1) + 1)]
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens joined by spaces, in UTF-8."""
        if not len(ids):
            return b""
        begin = self.starts[ids]
        sizes = self.starts[ids + 1] - begin
        ends = np.cumsum(sizes)
        return self.data[np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1])][:-1].tobytes()


class Encoder:
    """Texts to ids. Pieces and their normal form come from the tokenizer's own steps, on one chunk between white space at a time; ids come from the vocabulary's encoder."""

    def __init__(self, source: str) -> None:
        from tokenizers import Tokenizer

        if json.loads(source).get("decoder"):
            raise ValueError("the offset table joins tokens by spaces, as a tokenizer without a decoder does")
        self.vocabulary = Vocabulary(source)
        steps = Tokenizer.from_str(source)
        self.normalize = steps.normalizer.normalize_str
        self.split = steps.pre_tokenizer.pre_tokenize_str
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.plain = self._plain(json.loads(source))
        self.table = OffsetTable(self.vocabulary.texts)

    @staticmethod
    def _plain(spec: dict) -> regex.Pattern | None:
        """The splitting pattern, if on chunks of printable ASCII the tokenizer's steps amount to lower case and that pattern."""
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in splits] == ["Split", "ByteLevel"] and splits[0]["invert"] and splits[0]["behavior"] == "Removed" and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]:
            return regex.compile(splits[0]["pattern"]["Regex"])
        return None

    def pieces(self, text: str) -> list[str]:
        """The pieces of a stretch of text in byte characters, by the tokenizer's own steps; where these are plain, letters up to U+012F and printable ASCII skip them."""
        if self.plain:
            body, mark = (text, []) if text.isalpha() else (text[:-1], [text[-1]])
            if body.isalpha() and max(body) < "\u0130" and (not mark or mark[0] in PLAIN_MARKS):
                low = body.lower()
                return [low if low.isascii() else low.encode().decode("latin-1").translate(BYTE_CHARACTERS), *mark]
            if text.isascii() and text.isprintable():
                return self.plain.findall(text.lower())
        return [piece for piece, _ in self.split(self.normalize(text))]

    def remember(self, key: str, packed: bytes) -> bytes:
        if len(key) <= CACHE_CHUNK_CHARS:
            if len(self.cache) >= CACHE_CHUNKS:
                self.old, self.cache = self.cache, {}
            self.cache[key] = packed
        return packed

    def piece(self, piece: str) -> bytes:
        # a piece in ASCII is also a chunk with the same ids; others are kept apart by a mark that no chunk has
        key = piece if piece.isascii() else " " + piece
        if (packed := self.cache.get(key)) is not None:
            return packed
        if (packed := self.old.get(key)) is None:
            packed = np.array(self.vocabulary.encode_piece(piece), "<u4").tobytes()
        return self.remember(key, packed)

    def chunk(self, chunk: str) -> bytes:
        """The packed ids of a stretch of text without white space."""
        if (packed := self.old.get(chunk)) is not None:
            return self.remember(chunk, packed)
        v, parts, at = self.vocabulary, [], 0
        spans = [(m.start(), m.end()) for m in v.added.finditer(chunk)] if v.added and "<" in chunk else []
        for start, end in [*spans, (len(chunk), len(chunk))]:
            if start > at:
                parts += map(self.piece, self.pieces(chunk[at:start]))
            if end > start:
                parts.append(v.added_ids[chunk[start:end]].to_bytes(4, "little"))
            at = end
        return self.remember(chunk, parts[0] if len(parts) == 1 else b"".join(parts))

    def encode(self, text: str) -> bytes:
        chunks = SPACE_RUN.split(text) if NOT_SPACES.search(text) else text.split()
        get, make = self.cache.get, self.chunk
        return b"".join([x if (x := get(c)) is not None else make(c) for c in chunks if c])


_encoders: dict[int, Encoder] = {}


def _encoder(source: str) -> Encoder:
    """One encoder for each worker and vocabulary."""
    if (key := hash(source)) not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(source)
    return _encoders[key]


def load_vocabulary(path: str) -> str:
    """The tokenizer file's text, read once on the driver and sent with the code."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_encode_decode(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", decode: bool = True) -> DataFrame:
    """(id, ids, decoded): ids holds each text's token ids as little-endian unsigned 32-bit integers, decoded their tokens joined by spaces.

    A null text counts as an empty one: no ids and an empty decoded text. Special tokens that
    stand in a text become their ids. Repeated rows stay; further columns are not read, whatever
    their names. Texts are taken whole, whatever their length; memory holds one slice of a batch,
    and a bounded cache of chunks. No rows give no rows. A tokenizer file with a decoder of its own
    is refused.
    """
    source = load_vocabulary(tokenizer_path)
    kind = docs.schema[id_column].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(source)
        for batch in batches:
            for start, end in slices(batch.column(1)):
                part = batch.slice(start, end - start)
                ids = [encoder.encode(t or "") for t in part.column(1).to_pylist()]
                texts = [encoder.table.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in ids] if decode else [None] * len(ids)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "ids", "decoded"])

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return rows.mapInArrow(released(work), f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_column)
