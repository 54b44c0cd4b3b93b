"""Exact merge-type piece encoding by backtracking, and decoding.

A text is cut before every run of word marks: no piece holds a mark behind
another character, so no merge crosses such a cut. Each chunk is encoded
from the left: an Aho-Corasick pass gives the longest piece at each
position; a piece is taken if re-merging it with the piece before gives
back exactly the two; otherwise shorter prefixes are tried, and positions
from which no continuation exists are noted in a bitfield and never tried
again. Characters outside the vocabulary become their UTF-8 bytes' pieces.

Pieces of marks alone have equal scores, below all others; of equal pairs the
leftmost merges first, in pair checks as in whole texts, and the tests hold
runs of every length to 300, and some longer ones, against the library.

Defined results: a null or empty text encodes to the end id alone and
decodes to an empty text; repeated rows are encoded row by row; columns
besides the id and the text are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import slices, texts

MARK = "▁"
#: Entries a worker keeps in each of its caches before it starts anew; bounds memory, not results.
CACHE_ENTRIES = 400_000
#: Piece types of the model format (fixed values): normal, user-defined and unused pieces can be produced by merges; bytes stand for unknown characters.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class PieceEncoder:
    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != trainer.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or trainer.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models with identity normalisation and a leading word mark are supported")
        kinds = [p.type for p in model.pieces]
        if USER_DEFINED in kinds or kinds.count(BYTE) != 256:
            raise ValueError("only models with byte pieces and without user-defined pieces are supported")
        self.pieces = [p.piece for p in model.pieces]
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, UNUSED)}
        self.scores = {p.piece: p.score for p in model.pieces if p.type in (NORMAL, UNUSED)}
        self.end_id = next(i for i, p in enumerate(model.pieces) if p.piece == "</s>")
        self.silent = {i for i, k in enumerate(kinds) if k == CONTROL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a word mark behind another character: chunks could not be encoded alone")
        # only pieces that their own characters merge to can be part of an encoding
        own = [p for p in self.ids if self.merge(p) == [self.ids[p]]]
        self.lengths = {self.ids[p]: len(p) for p in own}
        reachable = set(own)
        self.shorter = {self.ids[p]: next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in reachable), None) for p in own}
        self.automaton = ahocorasick.Automaton()
        for p in own:
            self.automaton.add_word(p, (len(p) - 1, self.ids[p]))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.plain_from = 1 + max(i for i, k in enumerate(kinds) if k not in (NORMAL, UNUSED))
        self.chunks: dict[str, str] = {}
        self.irregular: dict[str, str] = {}

    def merge(self, text: str) -> list[int]:
        """Ids by plain merging: always the best-scored adjacent pair, leftmost among equals."""
        out: list[int] = []
        for s in self._merged(text) if len(text) > 24 else self._merged_short(text):
            out += [self.ids[s]] if s in self.ids else [self.byte_id[b] for b in s.encode()]
        return out

    def _merged_short(self, text: str) -> list[str]:
        """A few characters: the scores of all pairs in a list."""
        symbols, score, none = list(text), self.scores.get, float("-inf")
        pairs = [score(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while pairs and (best := max(pairs)) != none:
            i = pairs.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = score(symbols[i] + symbols[i + 1], none)
            if i:
                pairs[i - 1] = score(symbols[i - 1] + symbols[i], none)
        return symbols

    def _merged(self, text: str) -> list[str]:
        """Any length: a heap of pairs over a linked list of symbols."""
        symbols: list[str | None] = list(text)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(symbols):
                joined = symbols[i] + symbols[j]
                if joined in self.scores:
                    heapq.heappush(heap, (-self.scores[joined], i, symbols[i], symbols[j]))

        for i in range(len(symbols)):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= len(symbols) or symbols[j] != right:
                continue
            symbols[i], symbols[j] = left + right, None
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [s for s in symbols if s is not None]

    def _fits(self, left: int, right: int) -> bool:
        key = left << 20 | right
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > 4 * CACHE_ENTRIES:
                self.pairs.clear()
            ok = self.pairs[key] = self.merge(self.pieces[left] + self.pieces[right]) == [left, right]
        return ok

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a run of word marks and what follows, up to the next mark."""
        n = len(chunk)
        longest: list[int] = [-1] * n
        # matches come by their end, so the last one of a start is its longest
        for end, (back, piece) in self.automaton.iter(chunk):
            longest[end - back] = piece
        tokens: list[int] = []
        pairs, lengths, shorter = self.pairs, self.lengths, self.shorter
        failed = at = 0
        piece = longest[0]
        while at < n:
            if piece < 0:  # an unknown character: a bound that nothing merges across
                tokens.append(~at)
                at += 1
                piece = longest[at] if at < n else -1
                continue
            last = tokens[-1] if tokens else -1
            while True:
                end = at + lengths[piece]
                if not (failed and failed >> end & 1) and (last < 0 or pairs.get(last << 20 | piece) or (last << 20 | piece not in pairs and self._fits(last, piece))):
                    tokens.append(piece)
                    at = end
                    piece = longest[at] if at < n else -1
                    break
                piece = shorter[piece]
                if piece is None:
                    if last < 0:
                        raise AssertionError("a single character is always a valid piece")
                    failed |= 1 << at
                    piece = tokens.pop()
                    at -= lengths[piece]
                    break
        if min(tokens) >= 0:
            return tokens
        return [x for t in tokens for x in ([t] if t >= 0 else [self.byte_id[b] for b in chunk[~t].encode()])]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control pieces are silent, byte runs are read as UTF-8, marks are spaces, one leading mark goes."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if i in self.id_byte:
                held.append(self.id_byte[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i not in self.silent:
                out.append(self.pieces[i])
        out.append(held.decode("utf-8", "replace"))
        joined = "".join(out)
        return joined[joined.startswith(MARK) :].replace(MARK, " ")

    def _chunk(self, chunk: str) -> str:
        """The ids of a chunk, joined; a chunk that does not decode to itself is noted with what it decodes to."""
        ids = self.encode_chunk(chunk)
        if min(ids) >= self.plain_from:
            plain = "".join([self.pieces[i] for i in ids])
        else:
            # marks that begin a chunk stay: only a text's first one goes
            plain = MARK * (self.pieces[ids[0]][:1] == MARK) + self.decode(ids)
        if plain.replace(MARK, " ") != chunk.replace(MARK, " "):
            self.irregular[chunk] = plain
        return " ".join(map(str, ids))

    def split(self, text: str) -> list[str]:
        """Chunks of a text with its leading mark put on."""
        text = text.replace(MARK, " ")
        if text[:1] == " " or text[-1:] == " " or "  " in text:
            return re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))
        return [MARK + piece for piece in text.split(" ")]

    def run(self, batch: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, the ids joined by a space, and the decoded text of whole texts, the end id included."""
        if len(self.chunks) > CACHE_ENTRIES:
            self.chunks.clear()
            self.irregular.clear()
        known, out = self.chunks, []
        for text in batch:
            if not text:
                out.append((1, str(self.end_id), ""))
                continue
            parts = self.split(text)
            for part in set(parts).difference(known):
                known[part] = self._chunk(part)
            ids = " ".join(map(known.__getitem__, parts))
            # chunks hold whole characters, so a text decodes to its chunks' decodings
            if self.irregular and not self.irregular.keys().isdisjoint(parts):
                plain = "".join(self.irregular.get(p, p) for p in parts)[1:].replace(MARK, " ")
            else:
                plain = text.replace(MARK, " ")
            out.append((ids.count(" ") + 2, f"{ids} {self.end_id}", plain))
        return out


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; with keep_ids also ids array<int> and decoded string."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceEncoder(model)
        for batch in slices(batches):
            rows = coder.run(texts(batch))
            arrays = [
                batch.column(0),
                pa.array([n for n, _, _ in rows], pa.int64()),
                pa.array([hashlib.sha256(ids.encode()).hexdigest() for _, ids, _ in rows], pa.string()),
                pa.array([hashlib.sha256(plain.encode()).hexdigest() for _, _, plain in rows], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays += [pa.array([list(map(int, ids.split(" "))) for _, ids, _ in rows], pa.list_(pa.int32())), pa.array([plain for _, _, plain in rows], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)
