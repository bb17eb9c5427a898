"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch's distinct words become one flat numpy array of symbols. Each round
looks up the rank of every adjacent pair, takes the least rank per word,
merges its leftmost non-overlapping occurrences in all words at once and
compacts the array, until no pair remains. Ids equal those of the
sentencepiece library for BPE models with byte fallback, an identity
normaliser, a dummy prefix and kept white space; other models are refused.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import column, slices

_SPACE = "▁"
_WORDS = re.compile(r" *[^ ]+| +$")
_BIG = np.iinfo(np.int64).max
_CACHE_WORDS = 300_000   # words remembered per Python worker; speed only
_CACHE_CHARS = 64        # longer words are encoded anew each time


class PieceModel:
    """Tables of one model file and the merge rounds over them."""

    def __init__(self, path: str):
        import sentencepiece
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        kinds = [(lib.is_control(i) or lib.is_unknown(i), lib.is_byte(i), lib.is_unused(i)) for i in range(n)]
        if sum(k[1] for k in kinds) != 256 or any(k[2] for k in kinds):
            raise ValueError(f"{path}: only BPE models with byte fallback and no unused pieces")
        if lib.encode("  ﬁ x ", out_type=str)[:1] == [] or lib.decode(lib.encode("  ﬁ x ")) != "  ﬁ x ":
            raise ValueError(f"{path}: the normaliser must keep the text as it is")
        pieces = [lib.id_to_piece(i) for i in range(n)]
        normal = {pieces[i]: i for i in range(n) if not (kinds[i][0] or kinds[i][1])}
        score = {i: lib.get_score(i) for i in normal.values()}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = {i: order[s] for i, s in score.items()}
        self.n = n
        self.byte_id = np.zeros(256, np.int64)
        for i in range(n):
            if kinds[i][1]:
                self.byte_id[int(pieces[i][1:-1], 16)] = i
        # symbols: piece ids, then characters that only occur inside pieces,
        # then (base + code point) for characters that no piece holds
        chars = sorted({c for p in normal for c in p})
        sym = dict(normal)
        for c in chars:
            sym.setdefault(c, n + len(sym))
        self.base = max(sym.values()) + 1
        self.char_cp = np.array([ord(c) for c in chars], np.int64)
        self.char_sym = np.array([sym[c] for c in chars], np.int64)
        self.sym_cp = {sym[c]: ord(c) for c in chars if sym[c] >= n}
        self.width = self.base + 0x110000
        keys, merged, ranks = [], [], []
        unsafe = set()
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = sym.get(p[:k]), sym.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    merged.append(i)
                    ranks.append(rank[i])
                for j in (a, b):  # a part that the whole does not rank behind
                    if j is not None and j in rank and rank[i] <= rank[j]:
                        unsafe.add(j)
        o = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[o]
        self.merged = np.array(merged, np.int64)[o]
        self.ranks = np.array(ranks, np.int64)[o]
        self.unsafe = np.zeros(n + 1, bool)
        self.unsafe[list(unsafe)] = True
        self.bigrams = np.unique(np.array([ord(p[k]) << 21 | ord(p[k + 1]) for p in normal
                                           for k in range(len(p) - 1)], np.int64))
        self.words_split = not any(_SPACE in p.lstrip(_SPACE) for p in normal)
        self.text = [p.replace(_SPACE, " ") for p in pieces]
        self.byte_of = np.full(n, -1, np.int64)
        self.byte_of[self.byte_id] = np.arange(256)
        for b in range(128):
            self.text[self.byte_id[b]] = chr(b)
        for i in range(n):
            if kinds[i][0]:
                self.text[i] = " ⁇ " if lib.is_unknown(i) else ""
        self.prefix = np.zeros(n, bool)
        self.prefix[[i for p, i in normal.items() if p.startswith(_SPACE)]] = True
        self.cache: dict[str, bytes] = {}

    # -- encoding ------------------------------------------------------

    def _symbols(self, words: list[str]):
        cp = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), size)
        at = np.searchsorted(self.char_cp, cp).clip(max=len(self.char_cp) - 1)
        sym = np.where(self.char_cp[at] == cp, self.char_sym[at], self.base + cp)
        # no merge can cross two characters that no piece has side by side
        key = cp[:-1] << 21 | cp[1:]
        at = np.searchsorted(self.bigrams, key).clip(max=len(self.bigrams) - 1)
        new = np.ones(len(cp), bool)
        new[1:] = (self.bigrams[at] != key) | (word[1:] != word[:-1])
        return sym, np.cumsum(new) - 1, word

    def _pairs(self, sym: np.ndarray, seg: np.ndarray, at: np.ndarray):
        """Rank and merged id of the pairs that start at ``at``."""
        rank, new = np.full(len(at), _BIG), np.zeros(len(at), np.int64)
        ok = np.flatnonzero(at + 1 < len(sym))
        ok = ok[seg[at[ok]] == seg[at[ok] + 1]]
        key = sym[at[ok]] * self.width + sym[at[ok] + 1]
        to = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
        hit = self.keys[to] == key
        rank[ok[hit]], new[ok[hit]] = self.ranks[to[hit]], self.merged[to[hit]]
        return rank, new

    def _rounds(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols and the position each one starts at."""
        pos = np.arange(len(sym))
        done_s, done_p = [], []
        rank, new = self._pairs(sym, seg, np.arange(len(sym)))
        while len(sym):
            start = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            size = np.diff(np.r_[start, len(seg)])
            least = np.minimum.reduceat(rank, start)
            live = least < _BIG
            if not live.all():  # finished segments leave
                live = np.repeat(live, size)
                done_s.append(sym[~live])
                done_p.append(pos[~live])
                keep = np.flatnonzero(live)
                if not len(keep):
                    break
                least = np.repeat(least, size)[keep]
                sym, seg, pos, rank, new = sym[keep], seg[keep], pos[keep], rank[keep], new[keep]
            else:
                least = np.repeat(least, size)
            i = np.flatnonzero(rank == least)
            # leftmost of overlapping candidates: every other one of a run
            lead = np.r_[True, seg[i[1:]] != seg[i[:-1]]]
            run = lead | np.r_[True, np.diff(i) > 1]
            k = np.arange(len(i))
            take = (k - np.maximum.accumulate(np.where(run, k, 0))) % 2 == 0
            # a merge that could open a better one goes alone, leftmost first
            group = np.cumsum(lead) - 1
            risky = np.zeros(group[-1] + 1, bool)
            risky[group[self.unsafe[new[i]]]] = True
            take &= lead | ~risky[group]
            i = i[take]
            sym[i] = new[i]
            keep = np.ones(len(sym), bool)
            keep[i + 1] = False
            at = np.cumsum(keep)[i] - 1
            sym, seg, pos, rank, new = sym[keep], seg[keep], pos[keep], rank[keep], new[keep]
            changed = np.zeros(len(sym), bool)
            changed[at] = changed[at[at > 0] - 1] = True
            at = np.flatnonzero(changed)  # only these pairs changed
            rank[at], new[at] = self._pairs(sym, seg, at)
        s, p = np.concatenate(done_s), np.concatenate(done_p)
        o = np.argsort(p, kind="stable")
        return s[o], p[o]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """int32 ids of each word as bytes."""
        out: list[bytes] = []
        at = 0
        while at < len(words):  # about 1 M characters a time
            end, chars = at, 0
            while end < len(words) and (chars < 1 << 20 or end == at):
                chars += len(words[end])
                end += 1
            sym, seg, word = self._symbols(words[at:end])
            sym, pos = self._rounds(sym, seg)
            word = word[pos]
            odd = np.flatnonzero(sym >= self.n)
            if len(odd):  # characters without a piece become their bytes
                cps = [self.sym_cp[s] if s < self.base else s - self.base for s in sym[odd].tolist()]
                raw = [chr(c).encode("utf-8") for c in cps]
                reps = np.ones(len(sym), np.int64)
                reps[odd] = [len(r) for r in raw]
                ids, word = np.repeat(sym, reps), np.repeat(word, reps)
                ids[np.repeat(np.isin(np.arange(len(sym)), odd), reps)] = \
                    self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            else:
                ids = sym
            cut = np.searchsorted(word, np.arange(end - at + 1)) * 4
            raw = ids.astype(np.int32).tobytes()
            out += [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            at = end
        return out

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.words_split:
            return [" " + text]
        if _SPACE in text:
            text = text.replace(_SPACE, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return [" " + w for w in text.split(" ")]
        return _WORDS.findall(" " + text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """int32 ids of every text as bytes."""
        split = [self._words(t) for t in texts]
        cache = self.cache
        if len(cache) > _CACHE_WORDS:
            cache.clear()
        todo = list({w for ws in split for w in ws}.difference(cache))
        cache.update(zip(todo, self.encode_words([w.replace(" ", _SPACE) for w in todo]), strict=True))
        out = [b"".join([cache[w] for w in ws]) for ws in split]
        for w in todo:
            if len(w) > _CACHE_CHARS:
                del cache[w]
        return out

    # -- decoding ------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """Text of one id sequence: piece texts joined, runs of byte pieces
        read as UTF-8 (invalid bytes become U+FFFD), dummy prefix removed."""
        if not len(ids):
            return ""
        text = self.text
        high = self.byte_of[ids] >= 128
        if not high.any():
            out = "".join([text[i] for i in ids.tolist()])
        else:
            is_byte = self.byte_of[ids] >= 0
            cut = np.flatnonzero(np.r_[True, is_byte[1:] != is_byte[:-1], True])
            parts = []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if is_byte[a]:
                    parts.append(_utf8(bytes(self.byte_of[ids[a:b]].astype(np.uint8))))
                else:
                    parts.append("".join([text[i] for i in ids[a:b].tolist()]))
            out = "".join(parts)
        return out[1:] if self.prefix[ids[0]] else out


def _utf8(raw: bytes) -> str:
    """Valid characters as they are, one U+FFFD for each other byte."""
    out, i = [], 0
    while i < len(raw):
        for k in (1, 2, 3, 4):
            try:
                out.append(raw[i:i + k].decode("utf-8"))
                i += k
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) per row of ``docs``: the ids of
    the whole text without begin and end ids, and the text of those ids.

    Null text counts as empty (no ids, empty decoded text); ids may be null
    or repeated, one row out for each row in. Other columns are not read."""
    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("decoded", T.StringType())])

    def run(batches):
        m = load(model)
        for batch in slices(batches, text_col, 1 << 20):
            raw = m.encode([t or "" for t in column(batch, text_col).to_pylist()])
            off = np.cumsum([0, *map(len, raw)]) // 4
            ids = np.frombuffer(b"".join(raw), np.int32)
            decoded = [m.decode(ids[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, id_col), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids)),
                 pa.array(decoded, pa.string())], names=[id_col, "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
