"""SentencePiece encoding and decoding of merge-type vocabularies (operator 10).

Encoding keeps a score-ordered agenda of adjacent symbol pairs: the pair with the best score, the leftmost of equals, is
merged until no pair is in the vocabulary. No piece of such a vocabulary holds the space mark after another character,
so a text is the concatenation of independent units, each a run of marks and what follows; units repeat, so their
results are kept in a bounded cache. Each Arrow batch's new units are checked against the sentencepiece library.

Null texts count as empty; an empty text has no ids and decodes to an empty text. Repeated rows are repeated in the
result; other columns are kept, new ones are named n_tokens, ids_sha256 and decoded_sha256 (or ids and decoded).
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acutance.llm.common import tidy
from acutance.session import ship_package

MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Units that a worker keeps; then only those stay that the last two groups of texts share.
CACHE_UNITS = 350_000
#: Longer units aren't kept, and use a heap as their agenda.
SHORT_UNIT = 40
#: Rows of one matrix of units, characters of texts whose new units are learnt together, and the rank of no piece.
MATRIX_ROWS, BATCH_CHARS, NO_RANK = 50_000, 4 << 20, np.iinfo(np.int64).max


class PieceCodec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, model_file: str, verify: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = self.library.vocab_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        special = [self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        if any(MARK in p[1:] and p.strip(MARK) and not re.fullmatch(f"{MARK}*[^{MARK}]*", p) for p in self.ids):
            raise ValueError("a piece spans words; such a vocabulary isn't of the kind this encoder splits")
        self.rank = {p: -self.library.get_score(i) for p, i in self.ids.items()}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.surface = [p.replace(MARK, " ") for p in pieces]
        self.unknown = self.library.unk_id()
        self.byte_fallback = self.library.is_byte(self.bytes[0])
        self.verify = verify
        self.ids_of: dict[str, str] = {}
        self.last: set[str] = set()
        #: What a unit decodes to, if that isn't the unit itself.
        self.odd: dict[str, str] = {}
        # Tables for many units at once: ids of single characters, and the pairs that make a piece.
        chars = {ord(p): i for p, i in self.ids.items() if len(p) == 1}
        self.char_ids = np.full(max(chars) + 2, -1, np.int64)
        self.char_ids[list(chars)] = list(chars.values())
        order = {r: k for k, r in enumerate(sorted(set(self.rank.values())))}
        self.rank_piece = np.full((len(order), 1), -1, np.int64)
        shared: dict[float, int] = {}
        for r in self.rank.values():
            shared[r] = shared.get(r, 0) + 1
        self.pair_piece, pairs = {}, []
        for p, i in self.ids.items():
            r = self.rank[p]
            if shared[r] == 1:
                self.rank_piece[order[r], 0] = i
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs.append(((a << 20) | b, order[r]))
                    if shared[r] > 1:
                        self.pair_piece[a, b] = i
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], np.int64)

    def merge(self, unit: str) -> list[str]:
        return self._merge_list(unit) if len(unit) <= SHORT_UNIT else self._merge_heap(unit)

    def _merge_list(self, unit: str) -> list[str]:
        """The agenda as a list beside the symbols: min() finds the best score, index() the leftmost."""
        parts, rank, none = list(unit), self.rank, float("inf")
        agenda = [rank.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while agenda:
            best = min(agenda)
            if best == none:
                break
            i = agenda.index(best)
            parts[i] += parts.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = rank.get(parts[i - 1] + parts[i], none)
            if i < len(agenda):
                agenda[i] = rank.get(parts[i] + parts[i + 1], none)
        return parts

    def _merge_heap(self, unit: str) -> list[str]:
        """The agenda as a heap over a linked list of symbols; outdated pairs are skipped as they come up."""
        parts, rank, n = list(unit), self.rank, len(unit)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        agenda = [(rank[p], i, p) for i in range(n - 1) if (p := parts[i] + parts[i + 1]) in rank]
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i]
            if parts[i] is None or j < 0 or len(parts[i]) + len(parts[j]) != len(pair) or parts[i] + parts[j] != pair:
                continue
            parts[i], parts[j] = pair, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := parts[a] + parts[b]) in rank:
                    heapq.heappush(agenda, (rank[p], a, p))
        return [p for p in parts if p is not None]

    def unit_ids(self, unit: str) -> list[int]:
        out: list[int] = []
        for p in self.merge(unit):
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            else:
                out += self._fallback(p)
        return out

    def surface_of(self, ids: list[int]) -> str:
        if self.byte_of.keys().isdisjoint(ids):
            return "".join(map(self.surface.__getitem__, ids))
        out, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.surface[i])
        out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def units(self, text: str) -> list[str]:
        """The units of a text, each with its leading marks."""
        if not text:
            return []
        return UNIT.findall(MARK + text.replace(" ", MARK))

    def learn(self, words: set[str]) -> None:
        """Fill the cache for words (a word stands for the unit of one mark and the word) and check them with the library."""
        words = list(words)
        for w, got in zip(words, self.many_ids([MARK + w for w in words])):
            self.ids_of[w] = ",".join(map(str, got))
            back = self.surface_of(got)
            if back != " " + w:
                self.odd[w] = back
        if self.verify and words:
            # An empty word is a lone mark, which the library never sees as a text of its own.
            for w, theirs in zip(words, self.library.encode(words, num_threads=1)):
                if w and self.ids_of[w] != ",".join(map(str, theirs)):
                    raise AssertionError(f"unit {w!r}: {self.ids_of[w]} here, {theirs} by the library")

    def many_ids(self, units: list[str]) -> list[list[int]]:
        """The ids of many units at once. All short units take one merge a round: the agenda is a row of a matrix."""
        out: list = [None] * len(units)
        by_length: dict[int, list[int]] = {}
        for k, u in enumerate(units):
            if len(u) <= SHORT_UNIT:
                by_length.setdefault(len(u), []).append(k)
            else:
                out[k] = self.unit_ids(u)
        for n, at in by_length.items():
            for lo in range(0, len(at), MATRIX_ROWS):
                self._merge_matrix(units, at[lo : lo + MATRIX_ROWS], n, out)
        return out

    def _merge_matrix(self, units: list[str], at: list[int], n: int, out: list) -> None:
        codes = np.frombuffer("".join(units[k] for k in at).encode("utf-32-le"), np.uint32).reshape(len(at), n)
        symbols = self.char_ids[np.minimum(codes, len(self.char_ids) - 1)]
        symbols = np.where(symbols < 0, -2 - codes.astype(np.int64), symbols)
        agenda = self._ranks(symbols[:, :-1], symbols[:, 1:])
        rows, width = np.arange(len(at)), np.full(len(at), n)
        final = np.zeros((len(at), n), np.int64)
        while len(rows):
            none = np.zeros(len(rows), bool)
            best = np.zeros(len(rows), np.int64)
            if agenda.shape[1]:
                best = agenda.argmin(axis=1)
                none = agenda[np.arange(len(rows)), best] == NO_RANK
            else:
                none[:] = True
            if none.any():
                final[rows[none], : symbols.shape[1]] = symbols[none]
                width[rows[none]] = symbols.shape[1]
                rows, symbols, agenda, best = rows[~none], symbols[~none], agenda[~none], best[~none]
                if not len(rows):
                    break
            here, r = np.arange(symbols.shape[1] - 1)[None, :], np.arange(len(rows))
            merged = self.rank_piece[agenda[r, best], 0]
            tie = merged < 0
            if tie.any():  # several pieces have this score
                merged[tie] = [self.pair_piece[int(a), int(b)] for a, b in zip(symbols[r, best][tie], symbols[r, best + 1][tie])]
            symbols[r, best] = merged
            symbols = np.where(here <= best[:, None], symbols[:, :-1], symbols[:, 1:])
            agenda = np.where(here[:, :-1] < best[:, None], agenda[:, :-1], agenda[:, 1:])
            if agenda.shape[1]:
                right = best < agenda.shape[1]
                agenda[r[right], best[right]] = self._ranks(symbols[r[right], best[right]], symbols[r[right], best[right] + 1])
                left = best > 0
                agenda[r[left], best[left] - 1] = self._ranks(symbols[r[left], best[left] - 1], symbols[r[left], best[left]])
        for k, row, w in zip(at, final.tolist(), width.tolist()):
            got = row[:w]
            if min(got) < 0:
                got = [x for i in got for x in ([i] if i >= 0 else self._fallback(chr(-2 - i)))]
            out[k] = got

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair's piece in the order of scores, NO_RANK if the pair makes no piece."""
        keys = (np.maximum(a, -1) << 20) | (np.maximum(b, -1) & 0xFFFFF)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (a >= 0) & (b >= 0), self.pair_ranks[at], NO_RANK)

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.byte_fallback else [self.unknown]

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[str, int, str]]:
        """For each text: its ids joined by commas, their number and the decoded text."""
        plain = [bool(t) and MARK not in t and "  " not in t and t[0] != " " for t in texts]
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (size < BATCH_CHARS or hi == lo):
                size += len(texts[hi])
                hi += 1
            split = [t.split(" ") if p else None for t, p in zip(texts[lo:hi], plain[lo:hi])]
            known, odd = self.ids_of, self.odd
            every = set().union(*filter(None, split))
            missing = every - known.keys()
            if len(missing) + len(known) > CACHE_UNITS:
                often = [w for w in every & self.last if w in known]
                kept, kept_odd = [known[w] for w in often], {w: odd[w] for w in often if w in odd}
                known.clear()
                odd.clear()
                known.update(zip(often, kept))
                odd.update(kept_odd)
                missing = every - known.keys()
            self.last = every
            self.learn(missing)
            plain_back = odd.keys().isdisjoint(every)
            for t, words in zip(texts[lo:hi], split):
                if words:
                    ids = ",".join(map(known.__getitem__, words))
                    back = " " + t if plain_back else "".join([odd.get(w) or " " + w for w in words])
                else:
                    got = [self.unit_ids(u) for u in self.units(t)]
                    ids, back = ",".join(str(i) for g in got for i in g), "".join(map(self.surface_of, got))
                yield ids, ids.count(",") + 1 if ids else 0, back[1:] if back.startswith(" ") else back
            lo = hi

    def decode_ids(self, ids: list[int | None]) -> str:
        """The text of any ids, as the library gives it (broken byte pieces included); null ids and those that name no piece are left out."""
        return self.library.decode([int(i) for i in ids if i is not None and 0 <= i < self.library.get_piece_size()])


_codecs: dict[tuple[str, bool], PieceCodec] = {}


def codec(model_file: str, verify: bool = True) -> PieceCodec:
    key = (model_file, verify)
    if key not in _codecs:
        _codecs[key] = PieceCodec(model_file, verify)
    return _codecs[key]


def encode_decode(docs: DataFrame, model_file: str, text: str = "text", full: bool = False, verify: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256; with full, also ids (array) and decoded. Texts stay in their partitions."""
    ship_package(docs.sparkSession)
    out = T.StructType([f for f in docs.schema.fields if f.name not in {"n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"}])
    kept = list(out.names)
    out = out.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if full:
        out = out.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file, verify)
        gc.disable()  # millions of live strings make its passes slow, and there are no cycles
        try:
            yield from encoded(own, batches)
        finally:
            gc.enable()

    def encoded(own: PieceCodec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, a, b, ids, decoded = [], [], [], [], []
            for s, n, back in own.encode_texts([t or "" for t in batch.column(text).to_pylist()]):
                counts.append(n)
                a.append(hashlib.sha256(s.encode()).hexdigest())
                b.append(hashlib.sha256(back.encode()).hexdigest())
                if full:
                    ids.append([int(x) for x in s.split(",")] if s else [])
                    decoded.append(back)
            cols = [batch.column(c) for c in kept] + [pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = [*kept, "n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, out)


def decode(tokens: DataFrame, model_file: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """tokens with the text of each row's ids; null ids decode to an empty text."""
    ship_package(tokens.sparkSession)

    @F.udf("string", useArrow=True)
    def one(x):
        return codec(model_file).decode_ids(list(x)) if x is not None else ""

    return tokens.withColumn(to, one(F.col(ids)))
