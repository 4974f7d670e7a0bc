"""Exact BPE encoding and decoding with content-defined chunk reuse.

A rolling (gear) hash over the UTF-8 bytes cuts every text where its content says
so; equal passages of different documents therefore fall into equal chunks. Chunks
found more than once are encoded once, by the document of the smallest id that has
them, and their ids are joined to all others; a chunk found once is encoded where
it stands. Tokens near a chunk's ends may be wrong (a cut may split a word, or a
mark that normalisation would merge), so each join is repaired: the words around
the cut are encoded again as one window, which grows word by word until its outer
words come out exactly as in the two chunks; if it would outgrow them, both chunks
are encoded as one.

Why agreement is exact: no token, added token or normalisation of this vocabulary
spans a space, tab, line feed or carriage return, so ids between two such places
depend on nothing outside. The same lets each different word of a chunk be encoded once
and its ids be taken wherever it stands. Neighbouring chunks that a text has alone are encoded as one
piece, so that only joins with shared chunks need repair.

Plan. Texts are shuffled once, by doc_id, and that exchange serves both the owners'
encoding and the assembly. Hash counts are reduced map-side; a chunk that a third of
all documents share is one row of ids, and the rows that use it are split by the
adaptive skew join.

Defined results. Null or empty text: no ids, both digests of the empty string.
Repeated rows come back as often as they came in. A row without doc_id is encoded
without reuse. Ties (one chunk several times in a text) count. Empty table: no rows.
Other columns are ignored. Special-token strings in a text are encoded as the
library does by default, as those tokens.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagbill.llm.common import batches, cut, out, prepare


@dataclass(frozen=True)
class Chunking:
    """Cut rule, in bytes. ``mask_bits``: a cut every 2**mask_bits bytes on average."""
    least: int = 512
    most: int = 16384
    mask_bits: int = 11
    #: Words that each chunk has at least, so that joins have room for repair.
    words: int = 8


# ---- chunks ---------------------------------------------------------------

_GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, dtype=np.uint32)
_GAP = re.compile(rb"[ \t\n\r]+")


def _marks(data: np.ndarray, bits: int) -> np.ndarray:
    """Byte positions where a cut may be: the hash of the last 16 bytes has ``bits`` zero top bits."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8):                     # gear hash of 16 bytes by doubling
        more = h.copy()
        more[shift:] += h[:-shift] << np.uint32(shift)
        h = more
    at = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    at = at[at < len(data)]
    return at[(data[at] & 0xC0) != 0x80]            # never inside a character


def _has_words(piece: bytes, n: int) -> bool:
    return sum(1 for _, w in zip(range(n + 1), _GAP.finditer(piece))) > n


def chunks(text: bytes, rule: Chunking = Chunking()) -> list[bytes]:
    """Content-defined chunks; joined, they are the text."""
    if len(text) <= rule.least:
        return [text] if text else []
    data = np.frombuffer(text, np.uint8)
    marks = _marks(data, rule.mask_bits).tolist()
    cuts, last, k = [], 0, 0
    while True:
        while k < len(marks) and marks[k] - last < rule.least:
            k += 1
        at = marks[k] if k < len(marks) else len(text)
        if at - last > rule.most:                   # no mark in reach: cut by length
            at = last + rule.most
            while at < len(text) and data[at] & 0xC0 == 0x80:
                at += 1
        elif k < len(marks):
            k += 1
        while at < len(text) and not _has_words(text[last:at], rule.words):
            at = min(len(text), at + rule.most)     # too few words yet
            while at < len(text) and data[at] & 0xC0 == 0x80:
                at += 1
        if at >= len(text):
            break
        cuts.append(at)
        last = at
    while cuts and not _has_words(text[cuts[-1]:], rule.words):
        cuts.pop()
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]


def chunk_hash(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


# ---- encoding -------------------------------------------------------------

_ENCODERS: dict[str, Encoder] = {}
#: Bytes of a slice handed to the library; its time for longer texts grows faster than they do.
SLICE = 1024
#: Words that a worker remembers, and the bytes of the longest of them.
MOST_WORDS = 400_000
KNOWN_BYTES = 64
#: Stands between the words of a slice.
MARK = b"\x01"
_PARTED = b" " + MARK + b" "
#: Kinds of bytes: 0 white space, 2 letters, 3 marks that no contraction or added token has, 1 all others.
#: Words also end between letters and such marks, where the vocabulary's own pattern always parts a text.
_KIND = np.ones(256, np.uint8)
_KIND[list(b" \t\n\r")] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 2
_KIND[list(b'!"#$%&()*,.:;?')] = 3


class Encoder:
    """The library's tokenizer of one vocabulary file, with chunk joins repaired."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.number = [str(i) for i in range(size)]
        self.string = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.known: dict[bytes, bytes] = {}
        self.mark, = self._library([MARK])[0]

    @staticmethod
    def of(path: str) -> Encoder:
        """One encoder for each worker process and vocabulary."""
        if path not in _ENCODERS:
            import os
            os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark's tasks are the parallelism
            _ENCODERS[path] = Encoder(path)
        return _ENCODERS[path]

    def plain(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece by itself, some megabytes of text at a time; no token spans white space."""
        result: list[list[int]] = []
        at = 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (end == at or size + len(pieces[end]) <= 1 << 22):
                size += len(pieces[end])
                end += 1
            result += self._by_words(pieces[at:end])
            at = end
        return result

    def _by_words(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece from those of its words, of which each different one is encoded once."""
        data = np.frombuffer(b" ".join(pieces) + b" ", np.uint8)
        kind = _KIND[data]
        both = kind[1:] * kind[:-1]
        edge = np.flatnonzero((both == 6) | (both == 0) & (kind[1:] != kind[:-1])) + 1
        edge = np.concatenate(([0], edge, [len(data)]))
        word = kind[edge[:-1]] != 0
        starts, ends = edge[:-1][word], edge[1:][word]
        if not len(starts):
            return [[] for _ in pieces]
        offsets = np.concatenate(([0], np.cumsum(ends - starts)))
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(offsets), pa.py_buffer(data[kind != 0])]).dictionary_encode()
        parts = self._word_ids(coded.dictionary.to_pylist())
        word = np.asarray(coded.indices)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        first, n = (np.cumsum(sizes) - sizes)[word], sizes[word]
        total = np.concatenate(([0], np.cumsum(n)))
        ids = np.frombuffer(b"".join(parts), "<u4")[np.repeat(first - total[:-1], n) + np.arange(total[-1])].tolist()
        borders = np.cumsum([0] + [len(p) + 1 for p in pieces])
        cuts = total[np.searchsorted(starts, borders)].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _word_ids(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each of some different words; short ones are remembered."""
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        known = self.known
        found = list(map(known.get, words))
        # new words share slices, parted by a mark whose id no word without it has
        new = [i for i, x in enumerate(found) if x is None]
        apart = [i for i in new if MARK in words[i]]
        new = [i for i in new if MARK not in words[i]]
        for i, ids in zip(apart, self._library([words[i] for i in apart])):
            found[i] = np.array(ids, "<u4").tobytes()
        every = [x for ids in self._library(_slices(_PARTED.join([words[i] for i in new]))) for x in ids]
        ids = np.array(every, "<u4")
        ends = np.flatnonzero(ids == self.mark).tolist()
        for i, a, b in zip(new, [0, *(x + 1 for x in ends)], [*ends, len(ids)]):
            found[i] = ids[a:b].tobytes()
            if len(words[i]) <= KNOWN_BYTES:
                known[words[i]] = found[i]
        return found

    def _library(self, slices: list[bytes]) -> list[list[int]]:
        got = self.tok.encode_batch_fast([p.decode("utf-8", "replace") for p in slices], add_special_tokens=False)
        return [e.ids for e in got]

    def joined(self, docs: list[tuple[list[bytes], list[list[int]]]]) -> list[list[int]]:
        """Exact ids of each text, from its chunks and their ids."""
        result: list[list[int]] = []
        joins = [(d, i) for d, (pieces, _) in enumerate(docs) for i in range(len(pieces) - 1)]
        left_cut: dict[tuple[int, int], tuple[int, list[int], int]] = {}
        todo, width = joins, 2
        while todo:
            windows = [(j, *_window(docs[j[0]][0][j[1]], docs[j[0]][0][j[1] + 1], width)) for j in todo]
            enc = iter(self.plain([p for _, *ps in windows for p in ps]))
            todo = []
            for (d, i), *_ in windows:
                tail, guard_l, whole, guard_r, head = (next(enc) for _ in range(5))
                a, b = docs[d][1][i], docs[d][1][i + 1]
                if (_ends(a, tail) and _starts(tail, guard_l) and _starts(whole, guard_l)
                        and _starts(b, head) and _ends(head, guard_r) and _ends(whole, guard_r)):
                    left_cut[d, i] = (len(tail), whole, len(head))
                elif width < 4:
                    todo.append((d, i))
                else:
                    left_cut[d, i] = (-1, [], 0)
            width += 1
        for d, (pieces, ids) in enumerate(docs):
            if any(left_cut[d, i][0] < 0 for i in range(len(pieces) - 1)):
                result.append(self.plain([b"".join(pieces)])[0])      # no agreement: the whole text anew
                continue
            whole: list[int] = []
            skip = 0
            for i, own in enumerate(ids):
                if i + 1 < len(ids):
                    drop, window, skip_next = left_cut[d, i]
                    whole += own[skip:len(own) - drop]
                    whole += window
                    skip = skip_next
                else:
                    whole += own[skip:]
            result.append(whole)
        return result

    def encode(self, texts: list[bytes], known: list[dict[bytes, list[int]]], rule: Chunking) -> list[list[int]]:
        """Exact ids of whole texts; ``known`` has ids of shared chunks by hash."""
        split: list[list[bytes]] = []
        ids: list[list[list[int] | None]] = []
        missing: dict[bytes, list[tuple[int, int]]] = {}
        for d, (text, have) in enumerate(zip(texts, known)):
            pieces: list[bytes] = []
            own: list[list[int] | None] = []
            for p in chunks(text, rule) if have else [text]:
                got = have.get(chunk_hash(p)) if have else None
                if got is None and own and own[-1] is None:
                    pieces[-1] += p                     # neighbours to be encoded here need no join
                else:
                    pieces.append(p)
                    own.append(got)
            split.append(pieces)
            ids.append(own)
            for i, got in enumerate(own):
                if got is None:
                    missing.setdefault(pieces[i], []).append((d, i))
        for places, got in zip(missing.values(), self.plain(list(missing))):
            for d, i in places:
                ids[d][i] = got
        return self.joined(list(zip(split, ids)))

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False) for a vocabulary without decoder."""
        if self.tok.decoder is not None:
            return self.tok.decode(ids, skip_special_tokens=False)
        s = self.string
        return " ".join(map(s.__getitem__, ids))


def _slices(piece: bytes, size: int = SLICE) -> list[bytes]:
    """The piece cut before the first white space after every ``size`` bytes; no token spans such a place."""
    found, at = [], 0
    while len(piece) - at > size and (gap := _GAP.search(piece, at + size)):
        found.append(piece[at:gap.start()])
        at = gap.start()
    return [*found, piece[at:]]


def _starts(x: list[int], y: list[int]) -> bool:
    return x[:len(y)] == y


def _ends(x: list[int], y: list[int]) -> bool:
    return not y or x[-len(y):] == y


def _window(left: bytes, right: bytes, words: int) -> tuple[bytes, bytes, bytes, bytes, bytes]:
    """(tail, left guard, window, right guard, head) around the join of two chunks.

    The tail is the last ``words`` words of the left chunk, the head the first of
    the right one. Guards are their outer words, which the cut can't have touched.
    """
    size = 256
    while True:                                       # a look at the ends is nearly always enough
        end = left[-size:]
        gaps = [m.end() for m in _GAP.finditer(end)]
        if len(gaps) > words or size >= len(left):
            break
        size *= 4
    tail = end[gaps[-words]:]
    guard_l = end[gaps[-words]:gaps[-words + 1]]
    size = 256
    while True:
        begin = right[:size]
        gaps = [m.start() for m in _GAP.finditer(begin)]
        if len(gaps) > words or size >= len(right):
            break
        size *= 4
    head = begin[:gaps[words - 1]]
    guard_r = begin[gaps[words - 2]:gaps[words - 1]]
    return tail, guard_l, tail + head, guard_r, head


def _pack(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes() if ids and max(ids) > 0xFFFF else b"s" + np.asarray(ids, "<u2").tobytes()


def _unpack(data: bytes) -> list[int]:
    # a whole number of 4-byte ids has no odd byte in front
    return np.frombuffer(data[1:], "<u2").tolist() if len(data) % 2 else np.frombuffer(data, "<u4").tolist()


# ---- jobs -----------------------------------------------------------------

def shared_chunks(docs: DataFrame, rule: Chunking) -> DataFrame:
    """(doc_id, h, owner): the chunks of each document that occur more than once anywhere."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.binary()), ("n", pa.int64())])

    def hashes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            rows = [(i, h, n) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                    for h, n in Counter(map(chunk_hash, chunks(t or b"", rule))).items()]
            yield out(schema, *zip(*rows)) if rows else out(schema, [], [], [])

    found = cut(docs.filter("doc_id is not null").mapInArrow(hashes, "doc_id long, h binary, n long"))
    owners = (found.groupBy("h").agg(F.sum("n").alias("n"), F.min("doc_id").alias("owner"))
              .filter("n > 1").select("h", "owner"))
    return found.select("doc_id", "h").join(owners, "h").select("doc_id", "h", "owner")


def encode(docs: DataFrame, vocabulary: str, rule: Chunking = Chunking(), keep_text: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded, ids_sha256, decoded_sha256) for every row of ``docs``.

    ``keep_text`` off leaves out the ids and the decoded text themselves.
    """
    spark = docs.sparkSession
    prepare(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    uses = cut(shared_chunks(docs, rule))
    # Rows without an id must not meet in one partition; any spread will do for them.
    by_doc = docs.withColumn("at", F.coalesce("doc_id", F.xxhash64("text"))).repartition(n, "at")

    def own(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(vocabulary)
        schema = pa.schema([("h", pa.binary()), ("ids", pa.binary())])
        for b in batches(it, 128):
            want = {}
            for t, hs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                hs = set(hs)
                for c in chunks(t or b"", rule):
                    if (h := chunk_hash(c)) in hs:
                        want[h] = c
            if want:
                yield out(schema, list(want), [_pack(x) for x in enc.plain(list(want.values()))])

    owned = uses.filter("doc_id = owner").groupBy(F.col("doc_id").alias("at")).agg(F.collect_list("h").alias("hs"))
    # doc_id is read too, so that both uses of the texts share one exchange
    encoded = (by_doc.join(owned.hint("shuffle_hash"), "at").select("doc_id", "text", "hs")
               .mapInArrow(own, "h binary, ids binary").dropDuplicates(["h"]))
    known = (uses.join(encoded, "h").groupBy(F.col("doc_id").alias("at"))
             .agg(F.collect_list(F.struct("h", "ids")).alias("known")))

    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
              ("decoded_sha256", pa.string())]
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_text:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
        kinds += ", ids array<int>, decoded string"
    schema = pa.schema(fields)

    def assemble(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(vocabulary)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for b in batches(it, 64):
            doc_ids, texts = b.column(0).to_pylist(), [t or b"" for t in b.column(1).to_pylist()]
            have = [{x["h"]: _unpack(x["ids"]) for x in k or []} for k in b.column(2).to_pylist()]
            ids = enc.encode(texts, have, rule)
            number = enc.number.__getitem__
            decoded = [enc.decode(x) for x in ids]
            columns = [doc_ids, [len(x) for x in ids], [sha(" ".join(map(number, x))) for x in ids],
                       [sha(d) for d in decoded]]
            yield out(schema, *columns, *((ids, decoded) if keep_text else ()))

    return (by_doc.join(known.hint("shuffle_hash"), "at", "left").select("doc_id", "text", "known")
            .mapInArrow(assemble, kinds))
