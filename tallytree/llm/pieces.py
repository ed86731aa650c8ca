"""SentencePiece encoding and decoding (7): the N best segmentations of a text into pieces.

Forward Viterbi over the piece lattice gives the best score to reach each position. A backward search
from the end then uses them as exact heuristics (A-star): what it pops are the complete segmentations
in order of score. Pieces never cross from other characters to a space, nor over a character that no
piece has, so the lattice falls apart into chunks there; a chunk's lattice is solved once and cached, and
since its second best differs by the least loss at one position of its best path, only the few chunks
with the least losses need the A-star search for a text's N best. The result is that of the whole lattice.

Scores are the model's own (for a BPE vocabulary, the negative merge ranks). Characters without a piece
are written as their UTF-8 bytes' pieces, at the lowest score less ten. Spaces are the pieces' U+2581, a
dummy one stands before the text, and a U+2581 in the text itself goes to bytes, so decoding the ids
gives back the text exactly. Defined results: null and empty texts have no piece and score 0; ties take
the longest last piece and then the earlier chunk; repeated rows give one row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .hashing import mixed

MODEL, BEST, CACHE = "/opt/tokenizers/piece_bpe_32k.model", 4, 150_000
_CHUNKS = re.compile(r" *[^ \n]+| +|\n")
#: Chunks up to so many characters are solved together; by length, the width that holds it.
_WIDTHS = (8, 12, 20, 40)
_WIDTH_OF = [next(w for w in _WIDTHS if n <= w) for n in range(_WIDTHS[-1] + 1)]


class Pieces:
    """A vocabulary, read from a model file on whichever machine it is used."""

    def __init__(self, path: str = MODEL) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.path, self.table, self.byte, self.raw = path, {}, {}, {}
        for i in range(m.vocab_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                text = piece.replace("▁", " ")
                self.table[text] = (i, m.get_score(i))
                self.raw[i] = text.encode()
        crossing = [p for p in self.table if not _CHUNKS.fullmatch(p)]
        if crossing or m.vocab_size() > 1 << 16:
            raise ValueError(f"{path}: pieces may not go on after a newline or to a space after another character, as {crossing[0]!r} does" if crossing else f"{path}: ids must fit 16 bits")
        self.begins = {p[:k] for p in self.table for k in range(1, len(p) + 1)}
        self.lowest = min((s for _, s in self.table.values() if s > -1e8), default=0.0) - 10
        self.most = max(map(len, self.table))
        known = [(h, i, sc) for p, (i, sc) in self.table.items() for h in [int(self._hashes([p], len(p))[0][-1])]]
        self.hash, self.id, self.score = (np.array(x, t) for x, t in zip(zip(*known, strict=True), (np.uint64, np.int64, float), strict=True))
        order = np.argsort(self.hash)
        self.hash, self.id, self.score = self.hash[order], self.id[order], self.score[order]
        slots = (self.hash >> np.uint64(44)).astype(np.int64)
        self.at = np.zeros(1 << 20, np.int32)  # the last piece with these 20 bits; where several have them, a search tells
        self.at[slots] = np.arange(len(slots))
        self.shared = np.bincount(slots, minlength=1 << 20) > 1
        self.young: dict[str, tuple[bytes, float, float]] = {}
        self.old: dict[str, tuple[bytes, float, float]] = {}

    def _ids(self, piece: str) -> list[int]:
        found = self.table.get(piece)
        return [found[0]] if found else [self.byte[b] for b in piece.encode()]

    def lattice(self, text: str) -> tuple[list[float], list[list[tuple[int, float]]]]:
        """The best score to reach each position, and the edges (start, score) that end there."""
        n = len(text)
        best = [-np.inf] * (n + 1)
        best[0] = 0.0
        edges: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        table, begins = self.table, self.begins
        for a in range(n):
            here, alone = best[a], True
            for b in range(a + 1, n + 1):
                part = text[a:b]
                if part not in begins:
                    break
                if (found := table.get(part)) is not None:
                    alone = alone and b > a + 1
                    edges[b].append((a, found[1]))
                    if here + found[1] > best[b]:
                        best[b] = here + found[1]
            if alone:  # no piece for the character itself: its bytes
                edges[a + 1].append((a, self.lowest))
                best[a + 1] = max(best[a + 1], here + self.lowest)
        return best, edges

    def chunk(self, text: str) -> tuple[bytes, float, float]:
        """The best segmentation's ids (uint16 bytes), its score, and the loss of the second best."""
        best, edges = self.lattice(text)
        at, path, loss = len(text), [], np.inf
        while at:
            goal, chosen = best[at], None
            for a, s in edges[at]:
                less = goal - (best[a] + s)
                if less <= 0 and chosen is None:
                    chosen = a
                elif less < loss:
                    loss = less
            path.append(text[chosen:at])
            at = chosen
        ids = [i for p in reversed(path) for i in self._ids(p)]
        return np.array(ids, np.uint16).tobytes(), best[-1], float(loss)

    @staticmethod
    def _hashes(texts: list[str], width: int) -> list[np.ndarray]:
        """Hashes of the first 1, 2, ... characters of each text (all of ``width`` characters), one array a text."""
        codes = np.array(texts, f"<U{width}").view(np.uint32).reshape(len(texts), width)
        v, h, out = mixed(codes.astype(np.uint64) + np.uint64(1)), np.zeros(len(texts), np.uint64), []
        for k in range(width):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + v[:, k])
            out.append(h)
        return [np.array(x) for x in zip(*out, strict=True)]

    def chunks_at_once(self, texts: list[str]) -> list[tuple[bytes, float, float]]:
        """What ``chunk`` gives, for many short chunks: the same forward pass, vectorised over the chunks."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-sizes, kind="stable")
        size, width, n = sizes[order], int(sizes.max()), len(texts)
        codes = np.array(texts, f"<U{width}").view(np.uint32).reshape(n, width)[order]
        v = mixed(codes.T.astype(np.uint64) + np.uint64(1))
        first, second = np.full((width + 1, n), -np.inf), np.full((width + 1, n), -np.inf)
        back, ids = np.zeros((width + 1, n), np.int64), np.zeros((width + 1, n), np.int64)
        first[0] = 0
        odd = np.zeros(n, bool)
        for a in range(width):
            h = np.zeros(n, np.uint64)
            for b in range(a + 1, min(width, a + self.most) + 1):
                m = int(np.searchsorted(-size, -b, side="right"))  # the chunks of b characters at least come first
                if not m:
                    break
                h = mixed(h[:m] * np.uint64(0x9E3779B97F4A7C15) + v[b - 1, :m])
                slot = (h >> np.uint64(44)).astype(np.int64)
                k = self.at[slot].astype(np.int64)
                ok = self.hash[k] == h
                if len(again := np.flatnonzero(~ok & self.shared[slot])):
                    k[again] = np.minimum(np.searchsorted(self.hash, h[again]), len(self.hash) - 1)
                    ok[again] = self.hash[k[again]] == h[again]
                if b == a + 1:
                    odd[:m] |= ~ok
                hit = np.flatnonzero(ok)
                k = k[hit]
                total = first[a, hit] + self.score[k]
                before = first[b, hit]
                better = total > before
                second[b, hit] = np.where(better, before, np.maximum(second[b, hit], total))
                hit, k = hit[better], k[better]
                first[b, hit], back[b, hit], ids[b, hit] = total[better], a, self.id[k]
        at, loss = size.copy(), np.full(n, np.inf)
        path, steps = np.zeros((n, width), np.uint16), np.zeros(n, np.int64)
        row = np.arange(n)
        while len(row := row[(at[row] > 0) & ~odd[row]]):
            here = at[row]
            loss[row] = np.minimum(loss[row], first[here, row] - second[here, row])
            steps[row] += 1
            path[row, width - steps[row]] = ids[here, row]
            at[row] = back[here, row]
        out: list = [None] * n
        score = first[size, np.arange(n)].tolist()
        for i, (j, k, lose, bad) in enumerate(zip(order.tolist(), (width - steps).tolist(), loss.tolist(), odd.tolist(), strict=True)):
            out[j] = self.chunk(texts[j]) if bad else (path[i, k:].tobytes(), score[i], lose)
        return out

    def solve(self, lists: list[list[str]]) -> None:
        """Puts all chunks of a batch of texts into the cache; only texts of one batch may be looked up afterwards."""
        need = set().union(*lists)
        if len(self.young) + len(need) > CACHE:
            self.old, self.young = self.young, {}
        young = self.young
        missing = need.difference(young)
        known = missing.intersection(self.old)
        young.update(zip(known, map(self.old.__getitem__, known), strict=True))
        missing -= known
        new: dict[int, list[str]] = {w: [] for w in (*_WIDTHS, 0)}
        for c in missing:
            new[_WIDTH_OF[len(c)] if len(c) < len(_WIDTH_OF) else 0].append(c)
        for width, group in new.items():
            for k in range(0, len(group), 1 << 14):
                part = group[k : k + (1 << 14)]
                young.update(zip(part, self.chunks_at_once(part) if width else map(self.chunk, part), strict=True))

    def solved(self, chunks: list[str]) -> tuple[list[bytes], list[float], list[float]]:
        """The chunks' ids, scores and losses."""
        found = list(map(self.young.__getitem__, chunks))
        return [r[0] for r in found], [r[1] for r in found], [r[2] for r in found]

    def n_best(self, text: str, n: int) -> list[tuple[list[int], float]]:
        """The best ``n`` segmentations of one lattice, best first, by backward A-star."""
        best, edges = self.lattice(text)
        heap, out, tick = [(-best[-1], len(text), 0, 0.0, None)], [], 0  # of equal scores the one nearest to the start goes first
        while heap and len(out) < n:
            minus, at, _, done, path = heapq.heappop(heap)
            if at == 0:
                ids = []
                while path is not None:
                    ids += self._ids(path[0])
                    path = path[1]
                out.append((ids, -minus))
                continue
            for a, s in edges[at]:
                tick += 1
                heapq.heappush(heap, (-(best[a] + s + done), a, tick, done + s, (text[a:at], path)))
        return out

    def encode(self, text: str, n: int = 1) -> list[tuple[np.ndarray, float]]:
        """The best ``n`` segmentations of a text, as ids and scores."""
        chunks = _CHUNKS.findall(" " + text) if text else []
        self.solve([chunks])
        return self.best_of(chunks, n)

    def best_of(self, chunks: list[str], n: int) -> list[tuple[np.ndarray, float]]:
        """The same for the chunks of a text, which ``solve`` was given."""
        ids, scores, losses = self.solved(chunks)
        score = float(sum(scores))
        out = [(np.frombuffer(b"".join(ids), np.uint16), score)]
        for changes, s in self._others(chunks, losses, score, n):
            other = list(ids)
            for k, own in changes:
                other[k] = np.array(own, np.uint16).tobytes()
            out.append((np.frombuffer(b"".join(other), np.uint16), s))
        return out

    def _others(self, chunks: list[str], losses: list[float], score: float, n: int) -> list[tuple[list[tuple[int, list[int]]], float]]:
        """The second to n-th best of a text as changed chunks and scores: a best-first search over the chunks' own lists."""
        if n < 2:
            return []
        least = np.argsort(losses, kind="stable")[: n - 1].tolist()
        lists = [(k, self.n_best(chunks[k], n)) for k in sorted(least) if losses[k] < np.inf]
        # each state chooses a rank in the first lists; a state's successors raise the rank of its last chosen list or of a later one
        heap, out, tick = [], [], 0
        for j, (_, own) in enumerate(lists):
            if len(own) > 1:
                tick += 1
                heapq.heappush(heap, (own[0][1] - own[1][1], tick, j, 1, ()))
        while heap and len(out) < n - 1:
            loss, _, j, rank, before = heapq.heappop(heap)
            k, own = lists[j]
            chosen = (*before, (k, own[rank][0]))
            out.append((list(chosen), score - loss))
            if rank + 1 < len(own):
                tick += 1
                heapq.heappush(heap, (loss + own[rank][1] - own[rank + 1][1], tick, j, rank + 1, before))
            for i in range(j + 1, len(lists)):
                if len(lists[i][1]) > 1:
                    tick += 1
                    heapq.heappush(heap, (loss + lists[i][1][0][1] - lists[i][1][1][1], tick, i, 1, chosen))
        return out

    def decode(self, ids) -> str:
        raw = self.raw
        text = b"".join(map(raw.__getitem__, ids))
        return text[1:].decode() if text else ""


_loaded: dict[str, Pieces] = {}


def pieces(path: str = MODEL) -> Pieces:
    """This process's vocabulary: workers keep it, with its cache, from task to task."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _ends(lists: list) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32))


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(_ends(ids), pa.array(np.concatenate([*ids, np.zeros(0, np.uint16)]).astype(np.int32)))


def encode(docs: DataFrame, best: int = 1, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_pieces, score, others): the ids of the best segmentation and, as structs, the following ones."""

    def make(batch: pa.RecordBatch) -> dict:
        v, raw = pieces(model), [t.decode() for t in common.texts(batch.column(1))]
        lists = [_CHUNKS.findall(" " + t) if t else [] for t in raw]
        v.solve(lists)
        found = [v.best_of(chunks, best) for chunks in lists]
        ids = _lists([x[0][0] for x in found])
        later = [x[1:] for x in found]
        others = pa.StructArray.from_arrays([_lists([i for x in later for i, _ in x]), pa.array([s for x in later for _, s in x], pa.float64())], names=["ids", "score"])
        others = pa.ListArray.from_arrays(_ends(later), others)
        return {"doc_id": batch.column(0), "ids": ids, "n_pieces": [len(x[0][0]) for x in found], "score": [x[0][1] for x in found], "others": others}

    return common.map_rows(common.id_and_text(docs), make, "doc_id long, ids array<int>, n_pieces long, score double, others array<struct<ids:array<int>,score:double>>", most=1 << 20)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pieces(model).decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGEST = "doc_id long, n_pieces long, score double, other_scores array<double>, ids_sha256 string, round_trip boolean"


def digests(docs: DataFrame, best: int = BEST, model: str = MODEL) -> DataFrame:
    """What ``encode`` and ``decode`` give, without the ids themselves (their sha256 is over uint16, little-endian)."""

    def make(batch: pa.RecordBatch) -> dict:
        v, rows, raw = pieces(model), [], [t.decode() for t in common.texts(batch.column(1))]
        lists = [_CHUNKS.findall(" " + t) if t else [] for t in raw]
        v.solve(lists)
        for text, chunks in zip(raw, lists, strict=True):
            parts, scores, losses = v.solved(chunks)
            ids, score = b"".join(parts), float(sum(scores))
            others = [s for _, s in v._others(chunks, losses, score, best)]
            rows.append((len(ids) // 2, score, others, hashlib.sha256(ids).hexdigest(), v.decode(np.frombuffer(ids, np.uint16).tolist()) == text))
        return {"doc_id": batch.column(0)} | {k: [r[i] for r in rows] for i, k in enumerate(("n_pieces", "score", "other_scores", "ids_sha256", "round_trip"))}

    return common.map_rows(common.id_and_text(docs), make, DIGEST)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
