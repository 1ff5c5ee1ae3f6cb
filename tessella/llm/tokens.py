"""Token ids in binary shards: a wavelet matrix in each file, with access, counting and occurrence lookup."""

from __future__ import annotations

import io
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_range_shards, open_fs, session_of, small_batches, tidy
from .files import MANIFEST, Checked, TempFile, commit, manifest, manifest_batch, per_file, to_json

MAGIC = b"TWM1"
#: Bits of a bit-plane that are compressed together; ranks are sampled at their starts.
CHUNK = 1 << 19
#: Stretches of text that a Python worker keeps with their ids; beyond that it begins anew, so its memory is bounded.
CACHE = 1_200_000

#: A shard's file is closed, and the next of the shard begun, once it has so many tokens: a task's memory is bounded whatever its rows.
MOST_TOKENS = 1 << 24

_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of a Python worker: workers serve many tasks, and what one has seen helps the next."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _settled() -> str:
    """A character class of what every Unicode table since 3.2 takes for the same: letters, numbers, marks and signs of the first plane, blanks
    and line ends. Others may be letters to one library and unassigned to another."""
    import unicodedata

    old = unicodedata.ucd_3_2_0.category
    out, start = [], None
    for i in range(0x10000 + 1):
        c = chr(i)
        kind, was = unicodedata.category(c), old(c)
        good = i < 0x10000 and (c in "\t\n\x0b\x0c\r" or (kind[0] == was[0] and kind not in ("Cc", "Cf", "Cn", "Co", "Cs")))
        if good and start is None:
            start = i
        elif not good and start is not None:
            out.append(rf"\x{{{start:x}}}-\x{{{i - 1:x}}}")
            start = None
    return "".join(out)


class Pool:
    """Token ids of many strings, one after the other, and where each string's begin: a string is known by its number."""

    def __init__(self) -> None:
        self.ids, self.start, self.n = np.empty(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0
        self.add(np.empty(0, np.uint32), np.zeros(1, np.int64))  # number 0 has no ids

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Append strings by their ids in a row and the number of ids of each; the number of the first."""
        first, n, used = self.n, self.n + len(sizes), int(self.start[self.n])
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.empty(used + len(ids), np.uint32)])
        if n >= len(self.start):
            self.start = np.concatenate([self.start[: first + 1], np.empty(n, np.int64)])
        self.ids[used : used + len(ids)] = ids
        self.start[first + 1 : n + 1] = used + np.cumsum(sizes)
        self.n = n
        return first

    def __getitem__(self, number: int) -> np.ndarray:
        return self.ids[self.start[number] : self.start[number + 1]]

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings one after the other, and the bounds of each among them."""
        buffers = [None, pa.py_buffer(self.start[: self.n + 1] * 4), pa.py_buffer(self.ids)]
        _, bounds, ids = pa.Array.from_buffers(pa.large_binary(), self.n, buffers).take(pa.array(numbers)).buffers()
        bounds = np.frombuffer(bounds, np.int64)[: len(numbers) + 1] // 4
        return np.frombuffer(ids, np.uint32, bounds[-1]) if bounds[-1] else self.ids[:0], bounds


#: Stretches longer than this are not kept; a text that holds one is encoded as a whole.
LONGEST = 300
#: Stretches whose ids are put together at once, and bytes of text that are cut at once.
AT_ONCE, BATCH_TEXT = 1 << 19, 8 << 20
#: Bits that remember which stretches a worker has met before.
MET = 1 << 24
#: What may follow a letter only in a token of its own: ASCII signs without the apostrophe.
SIGNS = r"!-&(-/:-@\[-\x60{-~"
BLANKS = r"\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def places(words: pa.Array) -> np.ndarray:
    """A number below ``MET`` for each string, from its length and its first and last eight bytes."""
    if not len(words):
        return np.zeros(0, np.int64)
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    low, high = int(ends[0]), int(ends[-1])
    data = np.concatenate([np.zeros(8, np.uint8), np.frombuffer(data, np.uint8)[low:high] if high > low else np.empty(0, np.uint8), np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    size = np.diff(ends)
    out = (8 * np.maximum(8 - size, 0)).astype(np.uint64)  # bits that are not the string's
    first, last = eight[ends[:-1] - low + 8] << np.minimum(out, 63), eight[ends[1:] - low]
    first[size == 0], last[size < 8] = 0, 0
    mixed = (first ^ (last * np.uint64(0x9E3779B97F4A7C15)) ^ size.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(40)).astype(np.int64) & (MET - 1)


class Encoder:
    """Text to token ids: those of the tokenizers library with add_special_tokens=False, and nothing else.

    A byte-level tokenizer cuts a text into pre-tokens before it merges anything, and merges within each by itself. Where one space stands between
    two characters that are no white space, it cuts before the space, where one line end does, on both sides of it, and always between a letter and a sign of ``SIGNS``; so a text falls into stretches
    of a space or line end and what follows, or of a sign and what follows, and the ids of a stretch never depend on the others. A batch of texts is cut there and its different
    stretches are numbered; those met before are in the pool, the new ones are encoded together: the space or line end of a stretch has its own place in
    the ids, so those of many can be told apart again. Then the ids of all texts are gathered from the pool. The library itself encodes as a whole each text in
    which other white space stands beside a cut, that holds the literal of an added token (such as <|endoftext|>), a stretch of more than ``LONGEST``
    characters, or a character that not all Unicode tables class alike (``_settled``).
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.literals = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.largest = max(vocabulary.values())
        # The same model for strings of a space (or line end) and letters, over and over, which can be cut there alone; and the ids that begin a stretch.
        self.joined, self.begins = {}, {}
        for mark, how, starts in ((" ", "merged_with_next", "\u0120"), ("\n", "isolated", "\u010a")):
            self.joined[mark] = Tokenizer(self.tokenizer.model)
            split = pre_tokenizers.Split(mark, how)
            self.joined[mark].pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.begins[mark] = np.zeros(self.largest + 1, bool)
            self.begins[mark][[i for t, i in vocabulary.items() if t.startswith(starts)]] = True
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        self.unsure = f"[^{_settled()}]"
        self.unsure_leading = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", self.unsure)).search
        self.alone: dict[str, np.ndarray] = {}
        self.met = np.zeros(MET, bool)
        self._forget()

    def _forget(self) -> None:
        self.pool = Pool()
        #: Stretches met twice or more with their numbers, and those of what texts begin with; 0 marks what the shortcut can't vouch for.
        self.known, self.numbers = pa.array([], pa.string()), np.zeros(0, np.int64)
        self.leading: dict[str, int] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _one(self, pre_token: str) -> np.ndarray:
        if pre_token not in self.alone:
            self.alone[pre_token] = self.whole(pre_token)
        return self.alone[pre_token]

    def _together(self, words: pa.Array, mark: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of letters, each with ``mark`` before it, in a row, and their sizes."""
        lots = pa.ListArray.from_arrays(pa.array([*range(0, len(words), 1000), len(words)], pa.int32()), words)
        texts = [mark + t for t in pc.binary_join(lots, mark).to_pylist()]
        ids = [np.asarray(e.ids, np.uint32) for e in self.joined[mark].encode_batch_fast(texts, add_special_tokens=False)]
        row = np.concatenate([*ids, np.empty(0, np.uint32)])
        return row, np.diff(np.flatnonzero(self.begins[mark][row]), append=len(row)).astype(np.int64)

    def _number(self, stretches: pa.Array) -> np.ndarray:
        """Put new stretches into the pool; their numbers. A stretch after a line end begins with a zero character, one that begins with a sign with a one."""
        out = np.zeros(len(stretches), np.int64)
        if not len(stretches):
            return out
        mask = lambda a: a.to_numpy(zero_copy_only=False)
        line, sign = mask(pc.starts_with(stretches, "\0")), mask(pc.starts_with(stretches, "\1"))
        body = pc.if_else(pa.array(line | sign), pc.utf8_slice_codeunits(stretches, 1), stretches)
        size = mask(pc.utf8_length(body))
        bad = (size == 0) | (size > LONGEST) | mask(pc.match_substring_regex(body, self.unsure)) | mask(pc.match_substring_regex(body, f"^[{BLANKS}]|[{BLANKS}]$"))
        letters = mask(pc.utf8_is_alpha(body)) & ~bad
        for mark, these in ((" ", ~line), ("\n", line)):
            at = np.flatnonzero(letters & these)
            if len(at):
                out[at] = self.pool.add(*self._together(body.take(pa.array(at)), mark)) + np.arange(len(at))
        at = np.flatnonzero(~(bad | letters))
        ids = []
        for w, after_line, at_sign in zip(body.take(pa.array(at)).to_pylist(), line[at].tolist(), sign[at].tolist(), strict=True):
            before = [self._one("\n")] if after_line else []
            ids.append([*before, *map(self._one, self.cut(w if after_line or at_sign else " " + w))])
        sizes = np.array([sum(map(len, x)) for x in ids], np.int64)
        out[at] = self.pool.add(np.concatenate([*(y for x in ids for y in x), np.empty(0, np.uint32)]), sizes) + np.arange(len(at))
        return out

    def _lead(self, first: str, last: bool) -> int:
        """The number of what stands before the first cut of a text, 0 if the shortcut can't vouch for it."""
        if len(first) > LONGEST or (not last and (not first or first[-1].isspace())):
            return 0
        if first not in self.leading:
            known = 0 if self.unsure_leading(first) else -1
            if known:
                ids = [self._one(p) for p in self.cut(first)]
                known = self.pool.add(np.concatenate([*ids, np.empty(0, np.uint32)]), np.array([sum(map(len, ids))]))
            self.leading[first] = known
        return self.leading[first]

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; nulls are empty."""
        if not len(texts):
            return []
        texts = pc.fill_null(texts, "").cast(pa.string())
        if len(self.known) + len(self.leading) > CACHE:
            self._forget()
        if len(self.alone) > CACHE // 4:
            self.alone.clear()
        odd = np.zeros(len(texts), bool)
        for literal in (*self.literals, "\0", "\1"):
            odd |= pc.match_substring(texts, literal).to_numpy(zero_copy_only=False)
        marked = pc.replace_substring_regex(texts, r"(\S)\n(\S)", "\\1 \0\\2")
        cut = pc.split_pattern(pc.replace_substring_regex(marked, rf"(\pL)([{SIGNS}])", "\\1 \1\\2"), " ")
        bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        # The dictionary begins with the known stretches: each is one that it has met, and has its place.
        coded = pa.concat_arrays([self.known, cut.flatten()]).dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy()[len(self.known) :]
        after = np.ones(len(code), bool)
        after[bounds[:-1]] = False
        used = np.zeros(len(words), bool)
        used[code[after]] = True
        lead = [self._lead(words[int(code[a])].as_py(), b - a == 1) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        number = np.zeros(len(words), np.int64)
        number[: len(self.known)] = self.numbers
        # What is met for the second time is kept; what is met for the first time leaves the pool with the batch.
        new = np.flatnonzero(used[len(self.known) :]) + len(self.known)
        place = places(words.take(pa.array(new)))
        again, once = new[self.met[place]], new[~self.met[place]]
        self.met[place] = True
        kept = words.take(pa.array(again))
        number[again] = self._number(kept)
        self.known, self.numbers = pa.concat_arrays([self.known, kept]), np.concatenate([self.numbers, number[again]])
        n_kept = self.pool.n
        number[once] = self._number(words.take(pa.array(once)))
        number = number[code]
        number[bounds[:-1]] = lead
        odd |= np.logical_or.reduceat(number == 0, bounds[:-1])
        out: list[np.ndarray] = []
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + AT_ONCE, "right")) - 1)
            ids, at = self.pool.gather(number[bounds[low] : bounds[high]])
            ends = at[bounds[low : high + 1] - bounds[low]].tolist()
            out += [self.whole(texts[i].as_py()) if odd[i] else ids[a:b] for i, a, b in zip(range(low, high), ends, ends[1:], strict=False)]
            low = high
        self.pool.n = n_kept
        return out


def larger(batches: Iterator[pa.RecordBatch], column: int, most: int = BATCH_TEXT) -> Iterator[pa.RecordBatch]:
    """Arrow batches joined until a column has about ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if held and sum(h.column(column).nbytes for h in held) + b.column(column).nbytes > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if b.num_rows:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


# --- the wavelet matrix ------------------------------------------------------------------------------------------------


def _zstd():
    import zstandard

    return zstandard


def build(tokens: np.ndarray, docs: list[tuple[int | None, int]], bits: int) -> Iterator[bytes]:
    """The bytes of a shard file, piece by piece.

    Level by level, from the highest bit of a token on, the bits of all tokens are written in their present order; then the tokens are parted by that
    bit, order kept, zeros first. A level is stored as chunks of packed bits, each compressed, with the number of ones before each chunk.
    ``docs``: (doc_id, tokens) of each document in order.
    """
    z = _zstd().ZstdCompressor(level=1)
    at = len(MAGIC)
    yield MAGIC
    now = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
    levels = []
    for level in range(bits):
        bit = (now & now.dtype.type(1 << (bits - 1 - level))).astype(bool)
        chunks, ones, run = [], [], 0
        for i in range(0, len(bit), CHUNK):
            part = bit[i : i + CHUNK]
            ones.append(run)
            run += int(np.count_nonzero(part))
            data = z.compress(np.packbits(part, bitorder="little").tobytes())
            yield data
            chunks.append([at, len(data)])
            at += len(data)
        levels.append({"chunks": chunks, "ones": ones, "zeros": len(bit) - run})
        # Places first, then a gather: several times as fast as picking by a mask.
        now = np.concatenate([now[np.flatnonzero(~bit)], now[np.flatnonzero(bit)]])
    table = z.compress(to_json([[d for d, _ in docs], [n for _, n in docs]]))
    yield table
    foot = z.compress(to_json({"n": len(tokens), "bits": bits, "levels": levels, "docs": [at, len(table)]}))
    yield foot
    yield struct.pack("<I", len(foot)) + MAGIC


class Shard:
    """A shard file over a seekable source; chunks are read and unpacked when a question needs them."""

    def __init__(self, source, size: int) -> None:
        self.source, self.z = source, _zstd().ZstdDecompressor()
        tail = self._read(size - 8, 8)
        if tail[4:] != MAGIC or self._read(0, 4) != MAGIC:
            raise ValueError("not a token shard")
        length = struct.unpack("<I", tail[:4])[0]
        foot = json.loads(self.z.decompress(self._read(size - 8 - length, length)))
        self.n, self.bits, self.levels, self._docs = foot["n"], foot["bits"], foot["levels"], foot["docs"]
        self._last: dict[tuple[int, int], np.ndarray] = {}

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def docs(self) -> list[tuple[int | None, int]]:
        """(doc_id, tokens) in order."""
        ids, sizes = json.loads(self.z.decompress(self._read(*self._docs)))
        return list(zip(ids, sizes, strict=True))

    def _chunk(self, level: int, k: int) -> np.ndarray:
        key = (level, k)
        if key not in self._last:
            if len(self._last) >= 64:
                self._last.pop(next(iter(self._last)))
            raw = self.z.decompress(self._read(*self.levels[level]["chunks"][k]), max_output_size=CHUNK // 8)
            self._last[key] = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=min(CHUNK, self.n - k * CHUNK))
        return self._last[key]

    def bit(self, level: int, i: int) -> int:
        return int(self._chunk(level, i // CHUNK)[i % CHUNK])

    def ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a level."""
        k, r = divmod(i, CHUNK)
        if r == 0:
            known = self.levels[level]
            return known["ones"][k] if k < len(known["ones"]) else self.n - known["zeros"]
        return self.levels[level]["ones"][k] + int(np.count_nonzero(self._chunk(level, k)[:r]))

    def _find(self, level: int, value: int, j: int) -> int:
        """Where the ``j``-th (from 0) bit with that value stands in a level."""
        ones = self.levels[level]["ones"]
        before = lambda k: ones[k] if value else k * CHUNK - ones[k]
        low, high = 0, len(ones)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if before(mid) <= j else (low, mid)
        return low * CHUNK + int(np.flatnonzero(self._chunk(level, low) == value)[j - before(low)])

    def access(self, i: int) -> int:
        """The token at ``i``."""
        token = 0
        for level in range(self.bits):
            b = self.bit(level, i)
            one = self.ones(level, i)
            token = token << 1 | b
            i = self.levels[level]["zeros"] + one if b else i - one
        return token

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` occurs among the first ``i`` tokens."""
        start, end = 0, i
        for level in range(self.bits):
            a, b = self.ones(level, start), self.ones(level, end)
            if token >> (self.bits - 1 - level) & 1:
                zeros = self.levels[level]["zeros"]
                start, end = zeros + a, zeros + b
            else:
                start, end = start - a, end - b
        return end - start

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        return self.rank(token, self.n if end is None else end) - self.rank(token, start)

    def select(self, token: int, j: int) -> int:
        """Where ``token`` occurs for the ``j``-th time, from 0; -1 if it does not."""
        start, end = 0, self.n
        for level in range(self.bits):
            a, b = self.ones(level, start), self.ones(level, end)
            zeros = self.levels[level]["zeros"]
            start, end = (zeros + a, zeros + b) if token >> (self.bits - 1 - level) & 1 else (start - a, end - b)
        if j < 0 or start + j >= end:
            return -1
        i = start + j
        for level in range(self.bits - 1, -1, -1):
            zeros = self.levels[level]["zeros"]
            i = self._find(level, 1, i - zeros) if token >> (self.bits - 1 - level) & 1 else self._find(level, 0, i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens in order: the levels undone from the last to the first, a level at a time."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            raw = b"".join(self.z.decompress(self._read(*c), max_output_size=CHUNK // 8) for c in self.levels[level]["chunks"])
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=self.n).view(bool)
            zeros = self.levels[level]["zeros"]
            back = np.empty_like(now)
            back[np.flatnonzero(~bit)] = now[:zeros]
            back[np.flatnonzero(bit)] = now[zeros:] | now.dtype.type(1 << (self.bits - 1 - level))
            now = back
        return now


# --- writing and reading on the cluster --------------------------------------------------------------------------------


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(docs: DataFrame, out_dir: str, tokenizer: str, end: int = 0, bits: int = 16, shard_bytes: int = 12 << 20) -> DataFrame:
    """Encode every whole text, append the id ``end``, and write shard files in ascending doc_id order; return the manifest.

    Documents are ranged by doc_id, and of one doc_id by a hash of the text, into shards of about ``shard_bytes`` of text, by exact sums, and
    sorted in each; the texts are shuffled once and encoded in the task that writes them. A task holds the tokens of one file: a shard with more than
    ``MOST_TOKENS`` has several. ``tokenizer`` is the path of a tokenizers file, there on every executor; its ids must have ``bits`` bits at
    most. Literals of added tokens get the ids that the library gives them (see ``Encoder``). Null texts are empty: one id, the end. Null ids come first; of
    equal ids the hashes decide. A document longer than a shard makes a longer shard. No rows: a manifest without files. Other columns are not stored.
    """
    spark = session_of(docs)
    small_batches(spark)
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    narrow = docs.select(F.col("doc_id").cast("long").alias("key"), tie.alias("tie"), size.alias("weight"))
    rows = in_range_shards(docs.select("doc_id", "text", tie.alias("_tie")), narrow, "doc_id", "_tie", shard_bytes, "_tie", "text")
    rows = rows.select("doc_id", "text", "_shard")
    stop, kind = np.array([end], np.uint32), np.uint16 if bits <= 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, done = encoder_of(tokenizer), []
        if max(encoder.largest, end) >> bits:
            raise ValueError(f"the tokenizer has ids of more than {bits} bits")
        now, seq, held, ids, sizes, parts = None, 0, 0, [], [], []

        def close() -> None:
            nonlocal seq, held, ids, sizes, parts
            if not ids:
                return
            file = TempFile(out_dir, now, seq, ".twm")
            for data in build(np.concatenate(parts), list(zip(ids, sizes, strict=True)), bits):
                file.write(data)
            done.append(file.row(records=len(ids), units=held, first_id=ids[0], last_id=ids[-1]))
            seq, held, ids, sizes, parts = seq + 1, 0, [], [], []

        for b in larger(batches, 1):
            for doc_id, found, shard_id in zip(b.column(0).to_pylist(), encoder.batch(b.column(1)), b.column(2).to_pylist(), strict=True):
                if shard_id != now:
                    close()
                    now, seq = shard_id, 0
                ids.append(doc_id)
                sizes.append(len(found) + 1)
                parts.append(np.concatenate([found, stop]).astype(kind))
                held += len(found) + 1
                if held >= MOST_TOKENS:
                    close()
        close()
        yield manifest_batch(done)

    return commit(rows.mapInArrow(tidy(run), MANIFEST), out_dir)


def read_documents(spark: SparkSession, out_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the committed files, a shard at a time.

    start: the ids of all documents before it; ids_crc32: of its ids as little-endian unsigned 32-bit integers. A file whose length or digest is not
    that of the manifest is an error.
    """

    def run(row: dict) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(out_dir)
        with fs.open_input_stream(f"{base}/{row['name']}", compression=None) as f, Checked(f, row) as whole:
            data = whole.read()
        shard = Shard(io.BytesIO(data), len(data))
        tokens, docs = shard.tokens(), shard.docs()
        at, out = 0, []
        for doc_id, n in docs:
            out.append((doc_id, row["before"] + at, n, zlib.crc32(tokens[at : at + n].astype("<u4").tobytes())))
            at += n
        for i in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[i : i + 10_000], strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return per_file(manifest(spark, out_dir), run, "doc_id long, start long, n_tokens long, ids_crc32 long")
