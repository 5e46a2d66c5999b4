"""Exact SentencePiece BPE encoding by backtracking, and decoding.

BPE merges pairs by priority; instead of merging, this encoder looks for the one token sequence in which each token and each pair
of neighbours is what merging would give for it. From the left it takes the longest token that matches (Aho-Corasick finds all
matches of a word in one pass), and accepts it if merging the two neighbouring tokens' text again gives these two tokens. If not,
it goes on with the next shorter token that is a prefix; with none left, the last token is taken back and its end is marked as
failed in a bitfield, so that no position is tried twice.

White space marks start new words: if no vocabulary entry has one after another character, no merge crosses such a place, and
words are encoded one by one, with a bounded cache in each worker. Characters outside the vocabulary become byte tokens.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsearch.llm.common import buffer_of, ready, released, slices, text_or_empty

MARK = "▁"
#: One generation of a worker's cache of words: so many words, none longer than CACHE_LETTERS characters, so some 20 MB at most; the
#: older of two generations goes when the newer is full. Longer words (texts without spaces) are encoded each time.
CACHE_WORDS, CACHE_LETTERS = 100_000, 48
CACHE_PAIRS = 200_000


class Codec:
    """A BPE model of the sentencepiece library, read for its vocabulary and for decoding; encoding is done here."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        usual = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in usual}
        self.piece = {i: p for p, i in self.ids.items()}
        self.rank = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.length = [len(self.piece.get(i, "")) for i in range(size)]
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = sp.unk_id()
        self.byte_fallback = all(sp.is_byte(i) for i in self.bytes)
        self.known = {c for p in self.ids for c in p if c in self.ids}
        self.by_words = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.plain = all(sp.normalize(t) == self._mark(t) for t in ("a  b ", " a\tb\n", "ﬁ Å é", MARK, "<s>", " "))
        self.finder = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.finder.add_word(p, (len(p) - 1, i))
        self.finder.make_automaton()
        inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.never = {a + b for a in self.known for b in self.known if ord(a) < 0x180 and ord(b) < 0x180} - inside  # no token, so no merge, holds these
        self.shorter = [-1] * size  # the longest proper prefix that is a token
        for p, i in self.ids.items():
            self.shorter[i] = next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), -1)
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _mark(text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def merge(self, text: str) -> list[str]:
        """BPE by definition: the best-ranked neighbours merge first, the leftmost of equals."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Merging the text of the two tokens gives the two tokens. left -1: merging the right one's text gives it alone."""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            one = [self.piece[right]]
            if left >= 0:
                found = self.fits(-1, right) and self.merge(self.piece[left] + one[0]) == [self.piece[left], *one]
            else:
                found = self.merge(one[0]) == one
            self.pairs[key] = found
        return found

    def backtrack(self, text: str) -> list[int]:
        """The tokens of a text of known characters."""
        n = len(text)
        longest = [-1] * n if n < 4096 else array("i", [-1]) * n
        for end, (back, token) in self.finder.iter(text):  # ends ascend: the last token written at a start is the longest
            longest[end - back] = token
        length, shorter, pairs = self.length, self.shorter, self.pairs
        failed = bytearray((n >> 3) + 1)  # a bit for each position
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < n:
            while token >= 0:
                end = at + length[token]
                if not failed[end >> 3] >> (end & 7) & 1:
                    good = pairs.get(last << 32 | token)
                    if good or good is None and self.fits(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                last = token
                if at < n:
                    token = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()  # the first position never fails: a text of known characters has an encoding
                at -= length[token]
                last = out[-1] if out else -1
        return out

    def encode_part(self, text: str) -> bytes:
        """Token ids (32 bits each) of a normalised text."""
        known = self.known
        if known.issuperset(text):
            ids = self.backtrack(text)
        else:
            ids, run = [], []
            for c in [*text, None]:
                if c in known:
                    run.append(c)
                    continue
                if run:
                    ids += self.backtrack("".join(run))
                    run = []
                if c is not None:
                    if self.byte_fallback:
                        ids += [self.bytes[b] for b in c.encode()]
                    elif not ids or ids[-1] != self.unknown:
                        ids.append(self.unknown)
        return array("i", ids).tobytes()

    def word(self, w: str) -> bytes:
        """Of one word, through the cache; its end is cut off where no token crosses, and the parts go through the cache too."""
        if len(w) > CACHE_LETTERS:
            return self.encode_part(w)
        found = self.old.get(w)
        if found is None:
            never, n = self.never, len(w)
            while n > 1 and w[n - 2 : n] in never:
                n -= 1
            if n < len(w):
                found = (self.young.get(w[:n]) or self.word(w[:n])) + b"".join([self.young.get(c) or self.word(c) for c in w[n:]])
            else:
                found = self.encode_part(w)
        if len(self.young) >= CACHE_WORDS:
            self.old, self.young = self.young, {}
        self.young[w] = found
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not (self.plain and self.by_words):
            marked = self._mark(text) if self.plain else self.model.normalize(text)
            return b"".join(map(self.word, re.findall(f"{MARK}*[^{MARK}]*", marked))) if self.by_words else self.encode_part(marked)
        if "  " in text or text[0] == " " or MARK in text:
            parts = re.findall(f"{MARK}+[^{MARK}]*", self._mark(text))
        else:
            parts = (MARK + text.replace(" ", f" {MARK}")).split(" ")
        young, word = self.young.get, self.word
        return b"".join([young(w) or word(w) for w in parts])


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each model and worker process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, model: str, decode: bool = True) -> DataFrame:
    """doc_id, ids (array of int) and, if ``decode``, decoded (string) for every row of ``docs`` (columns doc_id, text; others are
    ignored), with the model file at path ``model``. Null and empty texts give no ids. One pass without a shuffle."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            buf, offs = buffer_of(b.column(1))
            for i, j in slices(offs, 1 << 20):
                raw = buf[offs[i] : offs[j]].tobytes()
                coded = [c.encode(raw[p:q].decode()) for p, q in zip(offs[i:j] - offs[i], offs[i + 1 : j + 1] - offs[i], strict=True)]
                at = np.cumsum([0, *(len(x) // 4 for x in coded)]).astype(np.int32)
                flat = np.frombuffer(b"".join(coded), np.int32)
                columns = [b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]
                if decode:
                    columns.append(pa.array([c.model.decode(flat[p:q].tolist()) if q > p else "" for p, q in zip(at[:-1], at[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    schema = "doc_id long, ids array<int>" + ", decoded string" * decode
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("_t")).mapInArrow(released(run), schema)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encode(docs, model).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
