"""SentencePiece encoding and decoding in batched numpy.

Texts are cut into chunks no piece crosses (a piece has the space mark only in front), by masks over the bytes of a part of the
column; Arrow numbers the part's distinct chunks, which are encoded once per part, and chunks of about equal length advance
together, padded to one width. From every start, substrings are hashed by one recurrence over the batch for as long as a piece
begins so; the hashes probe those of all that pieces begin with, and every piece hit is compared character by character.

* Unigram models: Viterbi. For each end position the best score over the piece lengths is a vectorised maximum, and its
  argument is the backpointer; a character that no piece covers is an unknown, scored below the least piece.
* BPE models: a Viterbi maximum of their scores isn't their segmentation (the scores are merge ranks), so chunks of one
  width run their merges together instead: the best adjacent pair of each chunk is a vectorised maximum, leftmost on ties.

Characters outside the vocabulary become byte pieces where the model has them, else the unknown piece. Decoding joins pieces,
turns byte runs into UTF-8 (U+FFFD where they aren't), and drops the dummy space; encoding a text and decoding it gives the
text back unless it holds the space mark U+2581 itself or a normaliser changed it. Columns of ids are decoded by one take of the
pieces' bytes; rows with control pieces or malformed byte runs go piece by piece. Models with a normaliser other than identity
are refused.

The model file is read on the driver, once; its pieces (bounded by the vocabulary) travel with the tasks. The path is a
parameter.

Edge cases: a null text has null ids and no pieces; an empty text has no pieces; chunks of any length are whole (very long
ones merge through a heap); rows are independent, so repeated rows and null ids pass through; an empty table gives an empty
result; extra columns are ignored by :func:`encode` and kept by :func:`tokenised`.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import col, fresh, sliced, table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Chunks beyond this length are merged one by one.
LONG_CHUNK = 96
#: Shorter chunks are padded to the next of these widths; longer ones are batched by their own length.
WIDTHS = (4, 7, 9, 11, 13, 16, 20, 26, 34)
#: Places of a batch of chunks: of the table of all substrings for Viterbi, of the chunks themselves for merges; positions of a long chunk whose pieces are looked up together.
TABLE, MERGES, BLOCK = 400_000, 100_000, 1 << 14
#: Rows, and bytes of text or ids, that are encoded or decoded together.
PART_ROWS, PART_BYTES, PART_IDS = 4096, 1 << 22, 1 << 20
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PAD = np.uint32(0xFFFFFFFF)


class Pieces:
    """A vocabulary that encodes and decodes. ``pieces``: (piece, score, type) by id."""

    def __init__(self, pieces: list[tuple[str, float, int]], unigram: bool, dummy_prefix: bool = True):
        self.unigram, self.dummy_prefix = unigram, dummy_prefix
        self.names = [p for p, _, _ in pieces]
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (_NORMAL, _USER, _UNUSED)}
        self.scores = np.array([s for _, s, _ in pieces], np.float64)
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == _UNKNOWN), 0)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == _BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.byte_piece = np.array([self.byte_ids.get(b, self.unknown) for b in range(256)], np.int32)
        self.silent = {i for i, (_, _, t) in enumerate(pieces) if t == _CONTROL}
        # Ids whose text stands by itself: pieces, and bytes of ASCII; the others are decoded in their runs.
        self.high = {i for i, b in self.byte_of.items() if b >= 128} | self.silent | {self.unknown}
        self.simple = [chr(self.byte_of[i]) if i in self.byte_of else p for i, p in enumerate(self.names)]
        self.longest = max(map(len, self.ids), default=1)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces with an inner space mark aren't supported")
        # All that pieces begin with, by hash: the piece's id, or -1 where none ends. By the top bits of the mixed hash: whether there
        # is a key, and the first of those keys.
        known = list(dict.fromkeys(p[:k] for p in self.ids for k in range(1, len(p) + 1)))
        sizes = np.array([len(p) for p in known], np.int64)
        codes = np.zeros((len(known), self.longest), np.uint32)
        codes[np.arange(self.longest) < sizes[:, None]] = np.frombuffer("".join(known).encode("utf-32-le", "surrogatepass"), np.uint32)
        keys = np.zeros(len(known), np.uint64)
        for k in range(self.longest):
            here = sizes > k
            keys[here] = keys[here] * _BASE + codes[here, k].astype(np.uint64) + np.uint64(1)
        order = np.argsort(keys * _MIX, kind="stable")
        self.keys, self.codes, self.by_key = keys[order], codes[order], np.array([self.ids.get(p, -1) for p in known], np.int32)[order]
        if len(self.keys) > 1 and (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        top, first, times = np.unique(_top(self.keys), return_index=True, return_counts=True)
        self.seen, self.slot, self.alike = np.zeros(1 << 20, bool), np.zeros(1 << 20, np.int32), int(times.max(initial=1))
        self.seen[top], self.slot[top] = True, first
        rank = np.unique(-self.scores, return_inverse=True)[1]
        self.priority = (rank.max(initial=0) + 1 - rank).astype(np.int32)  # higher merges first; 0 is no pair
        self._pair_table()
        joins = {c for p in self.ids if len(p) > 1 for c in p}
        self.alone = "".join(c for c in "\n\t\r" if c not in joins)
        cut = re.escape(self.alone)
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}{cut}]+|{SPACE}+" + (f"|[{cut}]" if cut else ""))
        self.least = float(self.scores.min()) - 10.0 if len(self.scores) else -10.0
        self.scores32 = np.append(self.scores, -np.inf).astype(np.float32)  # -1, no piece, is at the end
        self._text_table()

    @classmethod
    def load(cls, path: str = MODEL_PATH, viterbi: bool = False) -> Pieces:
        """The model in a file. ``viterbi``: its pieces as a unigram model; the merge ranks of a BPE model, which are no probabilities, become
        log-probabilities by Zipf's law, and nothing is trained."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models without a normaliser are supported")
        if model.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        pieces = [(p.piece, p.score, p.type) for p in model.pieces]
        unigram = model.trainer_spec.model_type == 1
        if viterbi and not unigram:
            plain = np.array([s for _, s, t in pieces if t == _NORMAL])
            low = plain.max(initial=0)
            total = np.log((1 / (low - plain + 2)).sum()) if len(plain) else 0.0
            pieces = [(p, -float(np.log(low - s + 2) + total) if t == _NORMAL else 0.0, t) for p, s, t in pieces]
        return cls(pieces, unigram or viterbi, norm.add_dummy_prefix)

    def _hits(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For chunks of one width as rows: the pieces of k + 1 characters as (k, rows, starts, ids), for each k; a start is left as soon as no piece begins so."""
        if not len(self.keys):
            return
        n, size = codes.shape
        line = np.append(codes, np.full((n, 1), _PAD), 1).ravel()  # no piece has the padding behind a row
        at = np.flatnonzero(line != _PAD)
        h = np.zeros(len(at), np.uint64)
        for k in range(self.longest):
            h = h * _BASE + line[at + k].astype(np.uint64) + np.uint64(1)
            top = _top(h)
            here = np.flatnonzero(self.seen[top])
            at, h, which = at[here], h[here], self.slot[top[here]]
            same = self.keys[which] == h
            for _ in range(self.alike - 1):
                which = np.where(same, which, np.minimum(which + 1, len(self.keys) - 1))
                same = self.keys[which] == h
            at, h, which = at[same], h[same], which[same]
            if not len(at):
                return
            ids = self.by_key[which]
            same = ids >= 0
            for j in range(k + 1):
                same &= self.codes[which, j] == line[at + j]
            yield k, *np.divmod(at[same], size + 1), ids[same]

    def _viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and id of the piece that ends at each position, by row; best total score, the longest piece on ties."""
        n, size = codes.shape
        reach = min(self.longest, size)
        best = np.full((n, reach + size + 1), -np.inf, np.float32)  # behind so many columns that every end has all lengths
        best[:, reach] = 0
        back, made, rows = np.zeros((n, size + 1), np.int32), np.full((n, size + 1), -1, np.int32), np.arange(n)
        block = max(BLOCK, self.longest)
        for a in range(0, size, block):
            b, s = min(a + block, size), max(0, a - reach + 1)
            ending = np.full((b - a, n, reach), -1, np.int32)  # by end, the longest first
            for k, row, start, ids in self._hits(codes[:, s:b]):
                end = start + (s + k - a)
                here = end >= 0
                ending[end[here], row[here], reach - 1 - k] = ids[here]
            scores = self.scores32[ending]
            scores[:, :, -1] = np.where(ending[:, :, -1] >= 0, scores[:, :, -1], np.float32(self.least))
            for end in range(a + 1, b + 1):
                options = best[:, end:end + reach] + scores[end - a - 1]
                pick = options.argmax(1)
                best[:, end + reach], back[:, end], made[:, end] = options[rows, pick], end - reach + pick, ending[end - a - 1, rows, pick]
        return back, made

    def _pair_table(self) -> None:
        """Every way to cut a piece into two pieces, as an open-addressing table from (left id, right id) to the piece's id."""
        cuts = [(self.ids[p[:k]], self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        bits = max(10, (4 * len(cuts)).bit_length())
        self.pair_shift, mask = np.uint64(64 - bits), (1 << bits) - 1
        self.pair_keys, self.pair_ids = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys = np.array([left << 32 | right for left, right, _ in cuts], np.int64)
        slots = ((keys.astype(np.uint64) * _BASE) >> self.pair_shift).astype(np.int64)
        self.probes = 1
        for key, slot, (_, _, i) in zip(keys.tolist(), slots.tolist(), cuts, strict=True):
            n = 1
            while self.pair_keys[slot] not in (-1, key):
                slot, n = (slot + 1) & mask, n + 1
            self.pair_keys[slot], self.pair_ids[slot] = key, i
            self.probes = max(self.probes, n)
        self.char_ids = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the piece that two pieces make together, or -1."""
        keys = left.astype(np.int64) << 32 | right
        slots = ((keys.astype(np.uint64) * _BASE) >> self.pair_shift).astype(np.int64)
        found = self.pair_keys[slots]
        out = np.where(found == keys, self.pair_ids[slots], -1)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & (len(self.pair_keys) - 1)
            found = self.pair_keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.pair_ids[slots[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        out[(left < 0) | (right < 0)] = -1
        return out

    def _merged(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row after all merges: piece starts, and the id at each start. A linked list of symbols, and the id and priority of
        the pair at each start, all rows merging their best pair together."""
        n, size = codes.shape
        pad = codes == _PAD
        sym = np.where(pad, -1, self.char_ids[np.where(pad, 0, codes)]).ravel()
        starts = np.ones(n * size, bool)
        if size > 1:
            end = np.arange(1, n * size + 1)  # where the symbol behind starts, over all rows in one line
            before = np.arange(-1, n * size - 1)
            made = np.full(n * size, -1, np.int32)
            made.reshape(n, size)[:, :-1] = self._joined(sym.reshape(n, size)[:, :-1].ravel(), sym.reshape(n, size)[:, 1:].ravel()).reshape(n, size - 1)
            rank = np.where(made >= 0, self.priority[made], 0)
            grid, live = rank.reshape(n, size), np.arange(n)
            while len(live):
                at = grid[live].argmax(1) + live * size
                go = rank[at] > 0
                live, at = live[go], at[go]
                last = live * size + size
                mid = end[at]
                stop = end[mid]
                sym[at], starts[mid], rank[mid], end[at] = made[at], False, 0, stop
                inner = stop < last
                before[stop[inner]] = at[inner]
                rank[at] = 0
                prev = before[at]
                led = prev >= last - size
                first = np.concatenate([at[inner], prev[led]])
                made[first] = self._joined(sym[first], sym[np.concatenate([stop[inner], at[led]])])
                rank[first] = np.where(made[first] >= 0, self.priority[made[first]], 0)
        return starts.reshape(n, size), sym.reshape(n, size)

    def _merge_long(self, chunk: str) -> list[str]:
        """The same merges for one long chunk, through a heap of pairs."""
        parts, left, right = list(chunk), list(range(-1, len(chunk) - 1)), [*range(1, len(chunk)), -1]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and right[i] >= 0 and (k := self.ids.get(parts[i] + parts[right[i]])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, parts[i] + parts[right[i]]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if not parts[i] or right[i] < 0 or parts[i] + parts[right[i]] != both:
                continue
            j = right[i]
            parts[i], parts[j], right[i] = both, "", right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [p for p in parts if p]

    def _bytes(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The byte pieces of characters behind one another, and how many each has."""
        size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        which = np.repeat(np.arange(len(code)), size)
        at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        length = size[which]
        bits = code[which] >> (6 * (length - 1 - at)).astype(code.dtype)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[length]
        return self.byte_piece[np.where(length == 1, bits, np.where(at == 0, lead | bits, 0x80 | bits & 0x3F)).astype(np.int64)], size

    def _filled(self, found: np.ndarray, rows: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and rows with byte pieces or the unknown piece in place of -1, which is always one character; ``code``: the first of each piece."""
        none = found < 0
        if not none.any():
            return found, rows
        if not self.byte_ids:
            keep = ~(none & np.append(False, none[:-1] & (rows[1:] == rows[:-1]))) if self.unigram else np.ones(len(none), bool)
            return np.where(none, self.unknown, found)[keep], rows[keep]
        spelt, sizes = self._bytes(code[none])
        counts = np.ones(len(found), np.int64)
        counts[none] = sizes
        out = np.repeat(found, counts)
        out[np.repeat(none, counts)] = spelt
        return out, np.repeat(rows, counts)

    def _spell(self, chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Encode chunks, of ``sizes`` characters behind one another, batch by batch of one width: ids, and of each chunk where its ids begin and how many they are."""
        begins = np.cumsum(sizes) - sizes
        flat, used, first, count = [], 0, np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        width = np.where(sizes <= WIDTHS[-1], np.array(WIDTHS)[np.minimum(np.searchsorted(WIDTHS, sizes), len(WIDTHS) - 1)], sizes)
        order = np.argsort(width, kind="stable")
        bounds = [0, *(np.flatnonzero(np.diff(width[order])) + 1).tolist(), len(order)] if len(order) else []
        for a, b in itertools.pairwise(bounds):
            size = int(width[order[a]])
            alone = size > LONG_CHUNK and not self.unigram
            step = 1 if alone else max(1, TABLE // (size * min(size, self.longest)) if self.unigram else MERGES // size)
            for at in range(a, b, step):
                batch = order[at:min(at + step, b)]
                if alone:
                    code = chars[begins[batch[0]]:begins[batch[0]] + size]
                    parts = self._merge_long(code.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass"))
                    found = np.array([self.ids.get(p, -1) for p in parts], np.int32)
                    rows, code = np.zeros(len(parts), np.int64), np.array([ord(p[0]) for p in parts], np.uint32)
                else:
                    found, rows, code = self._batch(chars, begins[batch], sizes[batch], size)
                found, rows = self._filled(found, rows, code)
                count[batch] = lengths = np.bincount(rows, minlength=len(batch))
                first[batch] = used + np.cumsum(lengths) - lengths
                flat.append(found)
                used += len(found)
        return np.concatenate([np.zeros(0, np.int32), *flat]), first, count

    def _batch(self, chars: np.ndarray, begins: np.ndarray, sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of chunks padded to ``size``: id or -1, row, and first character of each."""
        within = np.arange(size) < sizes[:, None]
        codes = np.where(within, chars[np.minimum(begins[:, None] + np.arange(size), len(chars) - 1)], _PAD)
        if self.unigram:
            back, made = self._viterbi(codes)
            starts = self._cuts(back, sizes)
        else:
            starts, sym = self._merged(codes)
        rows, places = np.nonzero(starts & within)
        ends = np.append(places[1:], 0)
        last = np.append(rows[1:] != rows[:-1], True)
        ends[last] = sizes[rows[last]]
        return made[rows, ends] if self.unigram else sym[rows, places], rows, codes[rows, places]

    @staticmethod
    def _cuts(back: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Piece starts from backpointers, from each row's end, all rows together."""
        n, size = back.shape[0], back.shape[1] - 1
        starts, end, rows = np.zeros((n, size), bool), sizes, np.arange(n)
        while len(rows):
            end = back[rows, end]
            starts[rows, end] = True
            rows, end = rows[end > 0], end[end > 0]
        return starts

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        return self.chunk.findall((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column behind one another, and where each text's ids end; a null has none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if pc.any(pc.match_substring(texts, SPACE)).as_py():
            texts = pc.replace_substring(texts, SPACE, " ")  # a space becomes the mark, so they are one character
        if self.dummy_prefix:
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(" ", texts, ""))
        offsets, data = _buffers(texts)
        blank, cut = data == 32, np.zeros(len(data), bool)
        for c in self.alone:
            cut |= data == ord(c)
        begins = cut.copy()
        begins[1:] |= cut[:-1] | (blank[1:] & ~blank[:-1])
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        places = np.append(np.flatnonzero(begins), len(data)).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(data)).dictionary_encode()
        plain = _buffers(chunks.dictionary)[1].tobytes().decode().encode("utf-32-le")
        chars = np.frombuffer(plain, np.uint32)
        flat, first, count = self._spell(np.where(chars == 32, np.uint32(ord(SPACE)), chars), pc.utf8_length(chunks.dictionary).to_numpy().astype(np.int64))
        known = chunks.indices.to_numpy()
        counts = count[known]
        upto = np.append(0, np.cumsum(counts))
        ids = flat[np.repeat(first[known] - upto[:-1], counts) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(places, offsets[1:])]

    def encode(self, text: str) -> list[int]:
        cut = self.chunks(text)
        flat, first, count = self._spell(np.frombuffer("".join(cut).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(c) for c in cut], np.int64))
        return [i for a, n in zip(first.tolist(), count.tolist(), strict=True) for i in flat[a:a + n].tolist()]

    def _text_table(self) -> None:
        """The bytes of each id, and behind them those it has at the front of a text, where the dummy space goes."""
        plain = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.silent else p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for i, p in enumerate(self.names)]
        if not self.byte_ids and plain:
            plain[self.unknown] = " ⁇ ".encode()
        self.texts = pa.array(plain + [p[1:] if self.dummy_prefix and p.startswith(b" ") else p for p in plain], pa.binary())
        self.is_silent, self.is_high = np.zeros(len(plain), bool), np.zeros(len(plain), bool)
        self.is_silent[list(self.silent)] = True
        self.is_high[[i for i, b in self.byte_of.items() if b >= 128]] = True

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """A string column of the texts whose ids lie behind one another and end at ``ends``."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.names):
            raise ValueError("a piece id outside the vocabulary")
        bounds = np.append(0, ends)
        front = bounds[:-1][bounds[:-1] < bounds[1:]]
        taken = np.array(ids, np.int32)
        taken[front] += len(self.names)
        spelt, data = _buffers(self.texts.take(pa.array(taken)))
        offsets = spelt[bounds]
        out = pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data))
        odd = self.is_silent[ids]
        if (high := self.is_high[ids]).any():
            raw = data.tobytes()
            inner = data[spelt[front]] & 0xC0 == 0x80  # a text that begins within a character
            if inner.any() or SPACE.encode() in raw or not _is_utf8(raw):
                odd = odd | high
        if odd.any():
            slow = np.unique(np.searchsorted(ends, np.flatnonzero(odd), "right"))
            mask = np.zeros(len(ends), bool)
            mask[slow] = True
            out = pc.replace_with_mask(out, pa.array(mask), pa.array([self.decode(ids[bounds[k]:bounds[k + 1]].tolist()) for k in slow.tolist()], pa.string()))
        return out

    def decode(self, ids: list[int]) -> str:
        if self.high.isdisjoint(ids):
            text = "".join(map(self.simple.__getitem__, ids)).replace(SPACE, " ")
            return text[1:] if self.dummy_prefix and text.startswith(" ") else text
        parts, raw = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                parts.append(_utf8(raw))
                raw = bytearray()
            if i == self.unknown and not self.byte_ids:
                parts.append(" ⁇ ")
            elif i not in self.silent:
                parts.append(self.names[i])
        if raw:
            parts.append(_utf8(raw))
        text = "".join(parts).replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def _top(keys: np.ndarray) -> np.ndarray:
    """Hashes mixed once more, as those of one character have no high bits; the upper 20 bits."""
    return (keys * _MIX >> np.uint64(44)).view(np.int64)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0, and bytes, of a string or binary column."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1] if offsets else np.zeros(1, np.int32)
    return at - at[0], np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data else np.zeros(0, np.uint8)


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def _utf8(raw: bytearray) -> str:
    """Bytes as text, with one U+FFFD for each byte outside well-formed characters."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(bytes(raw[at:at + n]).decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def tokenised(docs: DataFrame, model_path: str = MODEL_PATH, text_col: str = "text", keep: list[str] | None = None, round_trip: bool = True, viterbi: bool = False) -> DataFrame:
    """``docs`` (or the columns ``keep``) with ``n_tokens`` and ``ids``; ``round_trip`` adds whether decoding gives the text back."""
    model = Pieces.load(model_path, viterbi)
    kept = docs.columns if keep is None else keep
    names = [n if n.lower() not in {c.lower() for c in kept} else fresh(docs, n)[0] for n in ("n_tokens", "ids", "round_trip")][:3 if round_trip else 2]
    schema = docs.select(*[col(c) for c in kept]).schema
    text, = fresh(docs, "text")
    for name, kind in zip(names, ("bigint", "array<int>", "boolean")):
        schema = schema.add(name, T._parse_datatype_string(kind))

    def run(batches):
        for part in sliced(batches, len(kept), PART_ROWS, PART_BYTES):
            texts = part.column(part.num_columns - 1)
            ids, ends = model.encode_all(texts)
            bounds, null = np.append(0, ends).astype(np.int32), texts.is_null()
            lists = pa.ListArray.from_arrays(pa.array(bounds, mask=np.append(null.to_numpy(zero_copy_only=False), False)), pa.array(ids, pa.int32()))
            out = [pa.array(np.diff(bounds), pa.int64()), lists]
            if round_trip:
                out.append(pc.equal(model.decode_all(ids, ends), texts.cast(pa.string())))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *out], names=[*kept, *names])

    return docs.select(*[col(c) for c in kept], col(text_col).alias(text)).mapInArrow(run, schema)


def decoded(rows: DataFrame, model_path: str = MODEL_PATH, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``rows`` (or the columns ``keep``) with ``decoded``: the text of the piece ids; null for null, empty for no ids."""
    model = Pieces.load(model_path)
    kept = rows.columns if keep is None else keep
    ids, = fresh(rows, "ids")
    name = "decoded" if "decoded" not in {c.lower() for c in kept} else fresh(rows, "decoded")[0]
    schema = rows.select(*[col(c) for c in kept]).schema.add(name, T.StringType())

    def run(batches):
        for part in sliced(batches, len(kept), PART_ROWS, PART_IDS):
            column = part.column(part.num_columns - 1)
            values = column.flatten()
            if values.null_count:
                raise ValueError("a piece id is null")
            texts = model.decode_all(values.to_numpy(), np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(), dtype=np.int64))
            texts = pc.if_else(column.is_valid(), texts, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], names=[*kept, name])

    return rows.select(*[col(c) for c in kept], col(ids_col).alias(ids)).mapInArrow(run, schema)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(table(spark, sf_dir, "documents"), keep=["doc_id"])


def viterbi_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batched Viterbi over the file's pieces as a unigram model."""
    return tokenised(table(spark, sf_dir, "documents"), keep=["doc_id"], viterbi=True)


def decoded_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, decoded): the documents' ids turned back into text."""
    return decoded(tokenised(table(spark, sf_dir, "documents"), keep=["doc_id"], round_trip=False), keep=["doc_id", "n_tokens"])
