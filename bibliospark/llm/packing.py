"""Operator 9, lexical retrieval packing: BM25 neighbours share a window.

Documents become token ids with an end id, once, into a table. Document
frequencies of all token ids are counted over the whole corpus (at most one
row per vocabulary entry). Every document finds a partner in the whole corpus by
the pairs of its rarest terms, a join by pair (``nearest``), and documents of one
partner are dealt to one shard (``deal``). A shard holds an inverted index of
its documents with BM25 weights. Packing takes the next unused
document as the seed, asks the index for its unused neighbours by the seed's
rarest terms (by further ones while none is found), and fills the seed's window
with them, best first. The last one is cut at the window's end; what is left of
it seeds the next window. So every window of a shard but its last is full.

Plan, the same at any size: one pass tokenises; one pass over the ids counts;
one emits ten narrow rows a document, which are grouped, joined and summed; the
ids stay in the buckets they were made in until one shuffle by shard packs them. The driver holds the vocabulary's counts, a
task one shard (``SHARD_TOKENS`` on average, and never less than one document).
Groups larger than a shard, such as many copies, are dealt over several shards.

Defined cases: null text is empty and becomes the end id alone; equal rows are
packed once each; a null doc_id is kept; texts of special tokens are ordinary
text. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import sys
import threading
import zlib
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import materialise, small_batches, whole_text

WINDOW = 2048
END_ID = 1
#: Tokens of one shard, on average over hashed documents.
SHARD_TOKENS = 2_000_000
#: BM25 constants, terms of a query, neighbours asked for at a time.
K1, B = 1.2, 0.75
QUERY_TERMS = 12
NEIGHBOURS = 24
#: Rarest terms of a document whose pairs point to its partner.
LINK_TERMS = 5
#: Chunks whose ids a worker remembers (about 225 MB) until it has been idle for so
#: many seconds, and their longest; chunks encoded in one call; bytes of text looked
#: up together.
REMEMBERED, IDLE_SECONDS, CHUNK_CHARS, TOGETHER, TEXT_BYTES = 900_000, 5, 64, 2000, 2 << 20
#: Fixed value: how byte-level vocabularies write a blank.
BLANK = "\u0120"
#: Marks of chunks that no blank stands before. Texts that hold one of ``ODD`` (other
#: white space, runs of it) or match ``ODD_STOP`` (stops behind anything but letters
#: and digits) are cut at single blanks alone.
STOP, BREAK = "\x01", "\x02"
ODD = (STOP, BREAK, "  ", "\n\n", " \n", "\n ", " .", " ,", "\n.", "\n,", "_.", "_,",
       *[c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n"])
ODD_STOP = re.compile(r"[.,](?<=[^\w\s][.,])[ \n]")
#: Every odd text matches this, one search by Arrow; few others do.
MAYBE_ODD = "|".join([r"\A[ \n]", r"[ \n]\z", "[^0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f][.,][ \n]",
                      "[" + "".join(x for x in ODD if len(x) == 1) + "]",
                      *[re.escape(x) for x in ODD if len(x) > 1]])
#: Letters below this one are the same in all versions of Unicode.
LATIN_END = 0x250


PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def id_type(size: int) -> str:
    """Little-endian unsigned ids as narrow as the vocabulary allows."""
    return "<u2" if size <= 1 << 16 else "<u4"


class Encoder:
    """Token ids of whole texts by one tokenizers file.

    Byte-level BPE splits a text before every single blank between two
    non-blanks, before a full stop or comma between an alphanumeric character
    and a blank, and around a single line break. The chunks between those places
    are encoded on their own and remembered. New words of Latin letters are
    handed to the tokenizer's model one by one; other new chunks are encoded many
    to a call, as one text, and cut apart where ids begin with a blank. The ids
    are those of the whole text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.width = id_type(self.tokenizer.get_vocab_size())
        #: Chunks of late, and those before them: what is met again moves to the first.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.busy, self.rest = threading.Lock(), None
        self.blank = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.blank[k] = token.startswith(BLANK)
        self.line = np.zeros(len(self.blank), bool)
        self.line[self._ids(["\n"])[0]] = True
        # a blank and letters are one piece for the byte-level split, so such chunks go to
        # the model alone, written as that split writes them
        spec = json.loads(self.tokenizer.to_str())
        split = spec["pre_tokenizer"] or {}
        self.written = None
        if (split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
                and spec["normalizer"] is None and all(t["special"] for t in spec["added_tokens"])):
            level = ByteLevel(add_prefix_space=False, use_regex=False)
            self.written = {k: level.pre_tokenize_str(chr(k))[0][0] for k in range(0x80, LATIN_END)}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.width)
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _odd(text: str) -> bool:
        for x in ODD:
            if x in text:
                return True
        return text.strip(" \n") != text or ODD_STOP.search(text) is not None

    @staticmethod
    def _marked(texts: list[str]) -> pa.Array:
        """The texts, none odd, with a blank before every chunk: plain ones stand
        behind a blank, ones begun with ``STOP`` behind nothing, with ``BREAK`` behind
        a line break."""
        out = pa.array([STOP + x for x in texts], pa.large_string())
        for mark, place in ((BREAK, "\n"), (STOP + ". ", ". "), (STOP + ", ", ", ")):
            out = pc.replace_substring(out, place, " " + mark)
        return out

    @staticmethod
    def _odd_chunks(text: str) -> list[str]:
        """The chunks of an odd text, cut only at blanks between non-blanks."""
        if STOP in text or BREAK in text:
            return [STOP + text]
        head, *rest = re.split(r"(?<=\S) (?=\S)", text)
        return [STOP + head, *rest]

    def _together(self, words: list[str], mark: str, starts: np.ndarray) -> list[bytes]:
        """Ids of words, each with the mark before it."""
        out = []
        for k in range(0, len(words), TOGETHER):
            part = words[k:k + TOGETHER]
            (ids,) = self._ids([mark + mark.join(part)])
            at = np.flatnonzero(starts[ids]).tolist()
            if len(at) == len(part):
                data, size = ids.tobytes(), ids.itemsize
                at = [a * size for a in at] + [len(data)]
                out += [data[a:b] for a, b in zip(at, at[1:])]
            else:  # a vocabulary with the mark inside its tokens
                out += [x.tobytes() for x in self._ids([mark + c for c in part])]
        return out

    def _words(self, words: list[str], mark: str) -> list[bytes]:
        """Ids of words of Latin letters, each with the mark before it, by the model alone."""
        tokenize, written, ids, ends = self.tokenizer.model.tokenize, self.written, [], [0]
        for c in words:
            ids += [t.id for t in tokenize(mark + (c if c.isascii() else c.translate(written)))]
            ends.append(len(ids))
        ids = np.array(ids, self.width)
        data, size = ids.tobytes(), ids.itemsize
        return [data[a * size:b * size] for a, b in zip(ends, ends[1:])]

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks with what stands before them."""
        letters, plain, lines, odd = [], [], [], []
        for c in chunks:
            if self.written and c.isalpha() and (c.isascii() or ord(max(c)) < LATIN_END):
                letters.append(c)
            elif c == "" or c[-1].isspace() or " " in c or c[0] == STOP:
                odd.append(c)
            elif c[0] == BREAK:
                lines.append(c)
            else:
                plain.append(c)
        out = dict(zip(letters, self._words(letters, BLANK)))
        out.update(zip(plain, self._together(plain, " ", self.blank)))
        # chunks begun with a line break hold no other, so its id cuts them apart
        out.update(zip(lines, self._together([c[1:] for c in lines], "\n", self.line)))
        out.update(zip(odd, [x.tobytes() for x in self._ids([c[1:] if c[:1] == STOP else " " + c for c in odd])]))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.rest is not None:
            self.rest.cancel()
        with self.busy:
            out = self._encode(texts)
            if len(self.known) > REMEMBERED // 2:
                self.older, self.known = self.known, {}
        # an idle worker gives its memory back
        self.rest = threading.Timer(IDLE_SECONDS, self.forget)
        self.rest.daemon = True
        self.rest.start()
        return out

    def forget(self) -> None:
        with self.busy:
            self.known.clear()
            self.older.clear()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        at = []
        maybe = pc.match_substring_regex(pa.array(texts, pa.large_string()), MAYBE_ODD).to_pylist()
        for k, text in enumerate(texts):
            if maybe[k] and self._odd(text):
                chunks = self._odd_chunks(text)
                distinct = list(dict.fromkeys(chunks))
                ids = dict(zip(distinct, self._look_up(distinct)))
                out[k] = np.frombuffer(b"".join(map(ids.__getitem__, chunks)), self.width)
            else:
                at.append(k)
        if not at:
            return out
        # a chunk is looked up once a call, whatever its number
        cut = pc.split_pattern(self._marked([texts[k] for k in at]), " ")
        coded = cut.values.dictionary_encode()
        ids = self._look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)), out=ends[1:])
        flat = pa.Array.from_buffers(pa.large_binary(), len(ids),
                                     [None, pa.py_buffer(ends), pa.py_buffer(b"".join(ids))]).take(coded.indices)
        _, ends, data = flat.buffers()
        ends = np.frombuffer(ends, np.int64)[cut.offsets.to_numpy()]
        data = np.frombuffer(data or b"", np.uint8)
        for k, a, b in zip(at, ends[:-1].tolist(), ends[1:].tolist()):
            out[k] = data[a:b].view(self.width)
        return out

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        """Ids of these distinct chunks, new ones learned and, if short, remembered."""
        ids = list(map(self.known.get, chunks))
        at = [k for k, x in enumerate(ids) if x is None]
        if at:
            missing = [chunks[k] for k in at]
            found = list(map(self.older.get, missing))
            new = [c for c, x in zip(missing, found) if x is None]
            if new:
                learned = self._learn(new)
                found = [learned[c] if x is None else x for c, x in zip(missing, found)]
            for k, x in zip(at, found):
                ids[k] = x
            self.known.update(zip(missing, found))
            for c in missing:
                if len(c) > CHUNK_CHARS:
                    del self.known[c]
        return ids


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder, with what it remembers, for all tasks of a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def tokens(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text_hash, n, ids) per row of ``docs``: ids packed little-endian
    as wide as ``id_type`` says, the end id last."""
    def encode(batches):
        encoder = encoder_of(tokenizer_path or default_path())
        end = np.array([end_id], encoder.width)

        def done(held):
            coded = iter(encoder.encode([t for b in held for t in b.column(2).to_pylist()]))
            for b in held:
                ids = [np.concatenate((x, end)) for x in islice(coded, b.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "text_hash", "n", "ids"])

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column(2).nbytes
            if size >= TEXT_BYTES:
                yield from done(held)
                held, size = [], 0
        yield from done(held)

    small_batches(docs.sparkSession)
    text = whole_text("text")
    return (docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
            .mapInArrow(encode, "doc_id long, text_hash long, n long, ids binary"))


def distinct_ids(ids: np.ndarray) -> np.ndarray:
    """The distinct values in order; narrow ids take a radix sort."""
    ids = np.sort(ids, kind="stable")
    return ids[np.concatenate(([True], ids[1:] != ids[:-1]))]


def document_frequencies(tokenised: DataFrame, width: str) -> DataFrame:
    """(term, df) over all documents; as many rows as distinct token ids."""
    def count(batches):
        df = np.zeros(0, np.int64)
        for b in batches:
            seen = [distinct_ids(np.frombuffer(x, width)) for x in b.column(0).to_pylist()]
            if seen:
                now = np.bincount(np.concatenate(seen), minlength=len(df))
                now[:len(df)] += df
                df = now
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    return (tokenised.select("ids").mapInArrow(count, "term long, df long")
            .groupBy("term").agg(F.sum("df").alias("df")))


class Index:
    """BM25 postings of one shard: term -> places and weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.docs, self.n = docs, len(docs)
        self.rarest = np.argsort(-idf, kind="stable")
        self.rank = np.empty(len(idf), docs[0].dtype)
        self.rank[self.rarest] = np.arange(len(idf))
        sizes = np.array([len(x) for x in docs])
        ids = np.concatenate(docs)
        order = np.argsort(ids, kind="stable")  # by term, and by document in it
        term, place = ids[order], np.repeat(np.arange(self.n, dtype=np.int32), sizes)[order]
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (place[1:] != place[:-1]))))
        tf = np.diff(np.concatenate((first, [len(term)])))
        term, self.place = term[first], place[first].astype(np.intp)
        norm = K1 * (1 - B + B * sizes / mean)
        self.weight = (idf[term] * tf * (K1 + 1) / (tf + norm[self.place])).astype(np.float32)
        self.ends = np.cumsum(np.bincount(term, minlength=len(idf)))

    def neighbours(self, k: int, used: np.ndarray) -> list[int]:
        """Unused documents by BM25 score for the rarest terms of document k."""
        terms = self.rarest[distinct_ids(self.rank[self.docs[k]])]
        held = self.ends[terms] - np.where(terms > 0, self.ends[terms - 1], 0)
        terms = terms[held > 1]  # a term of no other document finds none
        at, size = 0, QUERY_TERMS
        while at < len(terms):
            t = terms[at:at + size]
            at, size = at + size, size * 2  # these find none: further terms
            runs = [slice(self.ends[x - 1] if x else 0, self.ends[x]) for x in t.tolist()]
            place = np.concatenate([self.place[r] for r in runs])
            if used[place].all():
                continue
            score = np.bincount(place, np.concatenate([self.weight[r] for r in runs]), self.n)
            score[used] = 0
            best = np.argpartition(-score, min(NEIGHBOURS, self.n - 1))[:NEIGHBOURS]
            best = best[score[best] > 0]
            if len(best):
                return best[np.lexsort((best, -score[best]))].tolist()
        return []


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int):
    """(document, start, length, sequence, offset) of every piece."""
    index, used, out = Index(docs, idf, mean), np.zeros(len(docs), bool), []
    waiting, seq, at, part = iter(range(len(docs))), 0, 0, None

    def place(k, start):
        """Append the document to the window; where it is cut, or None."""
        nonlocal at
        length = min(len(docs[k]) - start, window - at)
        out.append((k, start, length, seq, at))
        at += length
        return start + length if start + length < len(docs[k]) else None

    while True:
        if part is None:
            seed = next((k for k in waiting if not used[k]), None)
            if seed is None:
                return out
            used[seed], start = True, 0
        else:
            seed, start = part
        rest = place(seed, start)
        part = (seed, rest) if rest is not None else None
        while part is None and at < window:
            found = index.neighbours(seed, used)
            if not found:  # nothing alike is left: the next unused document
                k = next((k for k in waiting if not used[k]), None)
                if k is None:
                    return out
                found, seed = [k], k
            for k in found:
                used[k] = True
                rest = place(k, 0)
                if rest is not None:
                    part = (k, rest)
                if at == window:
                    break
        seq, at = seq + 1, 0


def term_pairs(made: DataFrame, df: np.ndarray, idf: np.ndarray, width: str) -> DataFrame:
    """(pair, key, weight): the pairs of a document's rarest terms among those
    that another document holds, with the sum of their idf. Terms are numbered
    by falling rarity, so a pair is exact: no hash stands for it."""
    order = np.argsort(np.where(df > 1, df, np.inf), kind="stable")
    held = int((df > 1).sum())
    rank = np.empty(len(df), width)
    rank[order] = np.arange(len(df))
    by_rank = idf[order].astype(np.float32)

    def pairs(batches):
        for b in batches:
            if not b.num_rows:
                continue
            keys, rows = b.column(0).to_numpy(zero_copy_only=False), []
            rarest = np.full((b.num_rows, LINK_TERMS), held)
            for k, x in enumerate(b.column(1).to_pylist()):
                r = distinct_ids(rank[np.frombuffer(x, width)])[:LINK_TERMS]
                rarest[k, :len(r)] = r
            for x, y in combinations(range(LINK_TERMS), 2):  # terms of no other document come last
                of = np.flatnonzero(rarest[:, y] < held)
                rows.append(np.stack((rarest[of, x], rarest[of, y], of)))
            first, second, of = np.concatenate(rows, axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array((first << 32) | second), pa.array(keys[of]),
                 pa.array(by_rank[first] + by_rank[second])], ["pair", "key", "weight"])

    return made.select("key", "ids").mapInArrow(pairs, "pair long, key long, weight float")


def nearest(made: DataFrame, df: np.ndarray, idf: np.ndarray, width: str) -> DataFrame:
    """(key, best): for every document that shares a pair of rare terms with
    another, the one that most of its pairs (by weight) point to.

    A pair points to the smallest key of its documents, for that one to the
    largest. So a pair of two documents links them, and one of many costs a row
    per document, never their pairs. The weight of a document's pairs with one
    partner is the part of its BM25 score that its rarest terms decide."""
    pairs = materialise(term_pairs(made, df, idf, width), "term-pairs")
    hubs = materialise(pairs.groupBy("pair").agg(F.min("key").alias("low"), F.max("key").alias("high"))
                       .where("low <> high"), "hubs")
    to = F.when(F.col("key") == F.col("low"), F.col("high")).otherwise(F.col("low"))
    votes = (pairs.join(hubs, "pair").select("key", to.alias("to"), "weight")
             .groupBy("key", "to").agg(F.sum("weight").alias("weight")))
    return materialise(votes.groupBy("key").agg(F.max_by("to", F.struct("weight", F.bitwise_not("to"))).alias("best")),
                       "nearest")


def deal(made: DataFrame, near: DataFrame, shards: int, shard_tokens: int) -> DataFrame:
    """``made`` with its shard. Documents of one group, the smallest key that
    two steps from partner to partner meet, share one; of a group larger than a
    shard, those with one partner do, and of these, if they are larger than a
    shard, each goes its own way."""
    further = near.select(F.col("key").alias("best"), F.col("best").alias("next"))
    sizes = made.groupBy("part", "key").agg(F.sum("n").alias("size"))
    nodes = materialise(
        sizes.join(near.join(further, "best", "left"), "key", "left")
        .select("part", "key", "size", F.least("key", "best", "next").alias("root"), F.least("key", "best").alias("pair")),
        "nodes")

    def large(*names):
        return (nodes.groupBy(*names).agg(F.sum("size").alias("size")).where(F.col("size") > shard_tokens)
                .select(*names, F.lit(True).alias("large_" + names[-1])))

    to = (nodes.join(large("root"), "root", "left").join(large("root", "pair"), ["root", "pair"], "left")
          .select("part", "key", F.xxhash64("root", F.when(F.col("large_root"), F.col("pair")),
                                    F.when(F.col("large_pair"), F.col("key"))).alias("to")))
    to = materialise(to.select("part", "key", F.pmod("to", F.lit(shards)).alias("shard")), "dealt")
    # the ids lie in buckets of ``part``: only the narrow side moves to meet them
    made.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return made.join(to.hint("shuffle_hash"), ["part", "key"])


def written_where_made(made: DataFrame) -> DataFrame:
    """``made`` and its ``part``, the task that made a row, as a table in buckets
    of ``part`` in the shared folder: written without a shuffle, and joined by
    (part, ...) without one. A task made anew has its number again."""
    spark = made.sparkSession
    path = scratch_path(spark, "tokens")
    name = path.rstrip("/").rsplit("/", 1)[-1].replace("-", "_").replace(".", "_")
    buckets = max(made.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    (made.withColumn("part", F.spark_partition_id()).write.mode("overwrite").option("compression", "zstd").option("path", path)
     .bucketBy(buckets, "part").saveAsTable(name))
    return spark.table(name)


def pack(docs: DataFrame, window: int = WINDOW, tokenizer_path: str | None = None,
         end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and the piece's ids if asked for. Sequence ids are
    unique, not dense: shard * 2^32 + the sequence's number in it."""
    from tokenizers import Tokenizer
    width = id_type(Tokenizer.from_file(tokenizer_path or default_path()).get_vocab_size())
    made = tokens(docs, tokenizer_path, end_id).withColumn("key", F.xxhash64("doc_id", "text_hash"))
    made = written_where_made(made)
    total, n_docs = made.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    counts = document_frequencies(made, width).toPandas()  # bounded by the vocabulary
    df = np.zeros(int(counts["term"].max()) + 1 if len(counts) else 1)
    df[counts["term"].to_numpy(np.int64)] = counts["df"]
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = total / max(n_docs, 1)
    shards = max(1, -(-total // shard_tokens))

    def pack_group(key, table):
        table = table.sort_by([("doc_id", "ascending"), ("text_hash", "ascending")])
        ids = [np.frombuffer(x, width) for x in table["ids"].to_pylist()]
        pieces = np.array(pack_shard(ids, idf, mean, window), np.int64).reshape(-1, 5)
        cut = [ids[k][s:s + n].astype("<u4").tobytes() for k, s, n in pieces[:, :3].tolist()]
        doc, start, length, seq, offset = pieces.T
        cols = [table["doc_id"].take(pa.array(doc)), start, length, [zlib.crc32(x) for x in cut],
                table["n"].take(pa.array(doc)), seq + (key[0].as_py() << 32), offset]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cut], pa.list_(pa.int32())))
            names.append("ids")
        return pa.table([pa.array(c, pa.int64()) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else c
                         for c in cols], names)

    dealt = deal(made, nearest(made, df, idf, width), shards, shard_tokens)
    dealt = dealt.select("shard", "doc_id", "text_hash", "n", "ids")
    return dealt.groupBy("shard").applyInArrow(pack_group, PIECES + (", ids array<int>" if with_ids else ""))
