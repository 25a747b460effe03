"""SentencePiece encoding and decoding of merge-type (BPE) models, by backtracking.

Encoding takes the longest piece at each place (all matches come from one Aho-Corasick automaton),
accepts it only if it can stand next to the piece before, and otherwise tries shorter pieces or
steps back; places that failed once are marked in a bit field and never entered again. Two pieces
can be neighbours if merging their characters anew, lowest rank first, gives these two again; only
the merges next to the place where they meet need be followed. A
sequence whose neighbours are all compatible is the one that the merges of the whole text give.

A text is first cut where a run of word marks begins, if the model has no piece that crosses such a
place (checked when it is loaded); equal words are encoded once, in a bounded memo per worker.
"""
import hashlib
import re
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetsieve.llm.common import tokenizer_file

MARK = "▁"
MEMO_ENTRIES = 400_000
MEMO_CHARS = 64
BLOCK = 4096  # characters of a unit whose matches are held at a time


class Codec:
    def __init__(self, model_file: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(model.get_piece_size())
                 if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.rank = {piece: -model.get_score(i) for piece, i in self.ids.items()}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(model.get_piece_size()) if model.is_byte(i)}
        self.text = {i: model.id_to_piece(i).replace(MARK, " ").encode() for i in plain}
        self.text |= {i: bytes([b]) for b, i in self.bytes.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.units = re.compile(f"{MARK}+[^{MARK}]*" if not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids) else r"(?s).+")
        self.compatible = lru_cache(1 << 17)(self._compatible)
        self.automaton = ahocorasick.Automaton()
        self.by_end, self.by_start, self.in_order = {}, {}, True
        for piece in self.ids:
            split = self.last_merge(piece)
            if split is not None:  # else no merges lead to it
                self.automaton.add_word(piece, (piece, len(piece) - 1))
                self.by_end[piece], self.by_start[piece] = split[1], split[0]
                self.in_order &= not split[1] or max(self.rank.get(x, -1) for x in split) < self.rank[piece]
        self.automaton.make_automaton()
        self.grows_left = lru_cache(1 << 16)(lambda piece: self._chain(piece, self.by_end))
        self.grows_right = lru_cache(1 << 16)(lambda piece: self._chain(piece, self.by_start))
        self.packed = {piece: np.array([i], "<u4").tobytes() for piece, i in self.ids.items()}
        self.plain = {piece: self.text[i] for piece, i in self.ids.items()}
        self.memo = {}

    def merge(self, parts: list[str], until=1) -> list[str]:
        """Merges of neighbours, lowest rank first, leftmost first."""
        while len(parts) > until:
            ranks = [self.rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == np.inf:
                break
            at = ranks.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def last_merge(self, piece: str):
        """The two pieces that a piece is merged from; two empty ones for a character."""
        if len(piece) == 1:
            return "", ""
        parts = self.merge(list(piece), 2)
        return tuple(parts) if len(parts) == 2 and len(self.merge(list(piece))) == 1 else None

    def _chain(self, piece: str, inner: dict) -> list[tuple[str, float]]:
        """The pieces at one end of a piece as they grow from a character to itself, each with the rank
        of the merge that takes it in."""
        chain = [(piece, np.inf)]
        while inner.get(chain[-1][0]):
            chain.append((inner[chain[-1][0]], self.rank[chain[-1][0]]))
        return chain[::-1]

    def _compatible(self, left: str, right: str) -> bool:
        if not self.in_order:  # a model whose pieces are older than their parts: merge all
            return self.merge([*left, *right]) == [left, right]
        lefts, rights = iter(self.grows_left(left)), iter(self.grows_right(right))
        (a, grow_a), (b, grow_b) = next(lefts), next(rights)
        while True:
            across = self.rank.get(a + b, np.inf)
            if grow_a <= across and grow_a <= grow_b and grow_a < np.inf:
                a, grow_a = next(lefts)
            elif across <= grow_b and across < np.inf:
                return False
            elif grow_b < np.inf:
                b, grow_b = next(rights)
            else:
                return True

    def _matches(self, unit: str):
        """matches(at): pieces that begin there, longest last; found block by block."""
        if len(unit) <= MEMO_CHARS:
            starts = [[] for _ in unit]
            for last, (piece, back) in self.automaton.iter(unit):
                starts[last - back].append(piece)
            return [x or [unit[at]] for at, x in enumerate(starts)].__getitem__
        held = {}

        def matches(at):
            low = at - at % BLOCK
            if low not in held:
                if len(held) > 3:
                    held.clear()
                text = unit[low:low + BLOCK + self.longest - 1]
                starts = held[low] = [[] for _ in text]
                for last, (piece, back) in self.automaton.iter(text):
                    starts[last - back].append(piece)
            return held[low][at - low] or [unit[at]]  # an unknown character stands alone

        return matches

    def pieces(self, unit: str) -> list[str]:
        matches, compatible = self._matches(unit), self.compatible
        failed = bytearray(len(unit) // 8 + 1)
        out, left, at = [], [], 0  # left[k]: choices not tried yet at piece k
        choices = matches(0)
        k, size, last = len(choices), len(unit), ""
        while at < size:
            while k:
                k -= 1
                piece = choices[k]
                to = at + len(piece)
                if not failed[to >> 3] >> (to & 7) & 1 and (not last or compatible(last, piece)):
                    out.append(piece)
                    left.append(k)
                    at, last = to, piece
                    if at < size:
                        choices = matches(at)
                        k = len(choices)
                    break
            else:
                if not out:
                    raise ValueError("no sequence of compatible pieces")
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(out.pop())
                k, last = left.pop(), out[-1] if out else ""
                choices = matches(at)
        return out

    def _ids(self, pieces: list[str]) -> list[int]:
        out = []
        for piece in pieces:
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            elif not out or out[-1] != self.unknown:  # neighbouring unknown characters are one
                out.append(self.unknown)
        return out

    def _learn(self, unit: str) -> tuple[bytes, bytes]:
        """Of a unit: ids as 32-bit integers, decoded bytes."""
        pieces = self.pieces(unit)
        try:
            found = b"".join([self.packed[x] for x in pieces]), b"".join([self.plain[x] for x in pieces])
        except KeyError:
            ids = self._ids(pieces)
            found = np.array(ids, "<u4").tobytes(), self.decode_bytes(ids)
        if len(unit) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[unit] = found
        return found

    def decode_bytes(self, ids) -> bytes:
        return b"".join(self.text.get(i, " ⁇ ".encode() if i == self.unknown else b"") for i in ids)

    def decode(self, ids) -> str:
        """Text of ids; begin and end ids give nothing, the mark set before the text is taken off again,
        bytes that aren't UTF-8 become replacement characters."""
        ids = list(ids)
        data = self.decode_bytes(ids)
        return data[data.startswith(b" "):].decode("utf-8", "replace")

    def parts(self, text: str):
        """Lists of (ids, decoded bytes) of the units of a text, without begin and end."""
        if text:
            text = MARK + text.replace(" ", MARK)
            found = (m[0] for m in self.units.finditer(text)) if len(text) > 1 << 20 else iter(self.units.findall(text))
            known, learn = self.memo.get, self._learn
            while some := list(islice(found, 1 << 16)):
                yield [known(u) or learn(u) for u in some]

    def encode(self, text: str) -> list[int]:
        ids = np.frombuffer(b"".join(x[0] for some in self.parts(text) for x in some), "<u4").tolist()
        return [self.begin, *ids, self.end]

    def digest(self, text: str, held: list | None = None) -> tuple[int, str, str]:
        """Number of ids with begin and end, SHA-256 of the ids and of the decoded text; the ids in
        between, as little-endian bytes, are added to `held`."""
        one = lambda i: np.array([i], "<u4").tobytes()
        n, ids, decoded, first = 2, hashlib.sha256(one(self.begin)), hashlib.sha256(), True
        for some in self.parts(text):
            packed = b"".join([x[0] for x in some])
            n += len(packed) // 4
            ids.update(packed)
            if held is not None:
                held.append(packed)
            data = b"".join([x[1] for x in some])
            decoded.update(data[1:] if first and data.startswith(b" ") else data)
            first = False
        ids.update(one(self.end))
        return n, ids.hexdigest(), decoded.hexdigest()


@lru_cache(maxsize=2)
def _codec(name: str) -> Codec:
    return Codec(tokenizer_file(name))


def encode_documents(docs: DataFrame, doc_id="doc_id", text="text", model="piece_bpe_32k.model", with_ids=False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves on request. A null text
    counts as empty: the begin and end ids, and an empty decoded text. Row by row, without a shuffle."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        codec = _codec(model)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 512):
                some = [x.as_py() for x in texts.slice(at, 512)]
                held = [[] for _ in some]
                rows = [codec.digest(x, own) for x, own in zip(some, held)]
                out = [batch.column(0).slice(at, 512), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    whole = [np.concatenate([[codec.begin], np.frombuffer(b"".join(own), "<u4"), [codec.end]]).astype(np.int32) for own in held]
                    out.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in whole])]).astype(np.int32), np.concatenate(whole)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return source.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode_documents(encoded: DataFrame, doc_id="doc_id", ids="ids", model="piece_bpe_32k.model") -> DataFrame:
    """doc_id, text of encoded documents; null ids give a null text."""
    source = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        codec = _codec(model)
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return source.mapInArrow(run, f"doc_id {kind}, text string")
