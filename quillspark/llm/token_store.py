"""Token-id files: blocks of ids under an adaptive context-mixing range coder, each reset and checksummed by itself.

Each id is predicted three times: by a distribution over all ids that counts what the block had so far, renewed every EVERY ids, sooner at first (order 0), and by the id that came
last after the id before (order 1) and after the two ids before (order 2), each with a confidence that grows when it is right. A mixer
adds the three predictions; its weights are learnt on the way, one set for each pair of confidences. The mixed distribution drives a
64-bit range coder. All of that starts afresh in each block, so a block needs nothing but itself, and a damaged one costs no other.

The coder is one Java class (``CODER``) that Spark's own compiler builds: built-in functions can't express a loop with state, and in
Python it would take microseconds an id. Files are read and written through Hadoop's file systems, so any shared folder will do.

File: MAGIC, u32 header length, JSON header, document table (zlib: doc_ids i64, known u8, lengths u32), u32 crc32 of all that, then
blocks, each u32 ids, u32 bytes, u32 crc32 of the coded bytes, coded bytes. Numbers are little-endian.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jvm
from .common import width

MAGIC = b"QSTK0002"
BLOCK = 1 << 16  # ids a block
FILE_IDS = 1 << 22  # a file is closed once it has so many ids; bounds what a task holds
ORDER = 16  # log2 of the slots of the order-1 and order-2 tables

CODER = """
import java.io.BufferedOutputStream;
import java.io.DataOutputStream;
import java.io.IOException;
import java.util.*;
import java.util.zip.*;
import java.nio.*;
import org.apache.hadoop.fs.FSDataInputStream;
import org.apache.hadoop.fs.FileSystem;
import org.apache.hadoop.fs.Path;
import org.apache.spark.sql.RowFactory;

class QuillCoder {
  static final int STEP = 24, PARTS = 4096, LEAST = 64, EVERY = 2048, FIND = 13;

  /** The state of one block: what order 0 counted, as sums that are renewed on the way; the guesses of orders 1 and 2; the weights. */
  static final class Model {
    final int vocab;
    final int[] count, sum, from = new int[(1 << FIND) + 2], t1 = new int[1 << %(order)d], t2 = new int[1 << %(order)d], hits = new int[4 * 16];
    int a, b, i1, i2, e1, e2, set, w0, w1, w2, seen, next, shift;

    Model(int vocab) {
      this.vocab = vocab;
      count = new int[vocab];
      sum = new int[vocab + 1];
    }

    void reset() {
      java.util.Arrays.fill(count, 1);
      java.util.Arrays.fill(t1, -1);
      java.util.Arrays.fill(t2, -1);
      for (int i = 0; i < 64; i += 4) { hits[i] = 2; hits[i + 1] = 2; hits[i + 2] = 8; }
      a = b = seen = 0;
      next = 64;
      renew();
    }

    /** Sums of the counts, and for each stretch of the sums the first id in it. */
    void renew() {
      int s = 0;
      for (int i = 0; i < vocab; i++) { sum[i] = s; s += count[i]; }
      sum[vocab] = s;
      shift = Math.max(0, 32 - Integer.numberOfLeadingZeros(s) - FIND);
      for (int k = 0, i = 0; k < from.length; k++) {
        while (i < vocab - 1 && (long) sum[i + 1] <= (long) k << shift) i++;
        from[k] = i;
      }
    }

    /** What orders 1 and 2 guess, a confidence of 0 to 3 in the low bits, and the parts of PARTS that each order gets. */
    void guess() {
      int h = (a + 1) * 0x9E3779B1;
      i1 = h >>> (32 - %(order)d);
      i2 = ((h ^ (h >>> 15)) + (b + 1) * 0x85EBCA6B) * 0xC2B2AE35 >>> (32 - %(order)d);
      e1 = t1[i1];
      e2 = t2[i2];
      set = (((e1 < 0 ? 0 : e1 & 3) << 2) | (e2 < 0 ? 0 : e2 & 3)) << 2;
      int n1 = e1 < 0 ? 0 : hits[set + 1], n2 = e2 < 0 ? 0 : hits[set], n = n1 + n2 + hits[set + 2];
      w1 = n1 * (PARTS - LEAST) / n;
      w2 = n2 * (PARTS - LEAST) / n;
      w0 = PARTS - w1 - w2;
    }

    /** The id whose share of order 0 holds u. */
    int find(int u) {
      int low = from[u >>> shift], high = from[(u >>> shift) + 1];
      while (low < high) {
        int mid = (low + high + 1) >>> 1;
        if (sum[mid] <= u) low = mid; else high = mid - 1;
      }
      return low;
    }

    void learn(int x) {
      boolean h1 = e1 >= 0 && (e1 >> 2) == x, h2 = e2 >= 0 && (e2 >> 2) == x;
      int won = h2 ? set : h1 ? set + 1 : set + 2;
      hits[won] += 2;
      if (hits[won] > 4000) { hits[set] = (hits[set] >> 1) + 1; hits[set + 1] = (hits[set + 1] >> 1) + 1; hits[set + 2] = (hits[set + 2] >> 1) + 1; }
      t1[i1] = h1 ? ((e1 & 3) < 3 ? e1 + 1 : e1) : e1 >= 0 && (e1 & 3) > 1 ? e1 - 1 : x << 2;
      t2[i2] = h2 ? ((e2 & 3) < 3 ? e2 + 1 : e2) : e2 >= 0 && (e2 & 3) > 1 ? e2 - 1 : x << 2;
      count[x] += STEP;
      b = a;
      a = x;
      if (++seen == next) {
        next += Math.min(next, EVERY);
        renew();
      }
    }
  }

  /** Codes n ids of a block: out of x into buf, or, if decoding, out of buf (from at to end) into x. Returns the bytes. */
  static int code(Model m, int[] x, int from, int n, byte[] buf, int at, int end, boolean decode) {
    m.reset();
    long low = 0, range = -1L, code = 0;
    int begin = at;
    if (decode) for (int i = 0; i < 8; i++) code = (code << 8) | (at < end ? buf[at++] & 255 : 0);
    for (int k = 0; k < n; k++) {
      m.guess();
      int g1 = m.e1 >> 2, g2 = m.e2 >> 2, id;
      long all = m.sum[m.vocab], r = ((range >>> 1) / (all * PARTS)) << 1;
      if (decode) {
        long v = Math.min(Long.divideUnsigned(code - low, r), all * PARTS - 1), less = 0;
        id = -1;
        int first = Math.min(g1, g2), last = Math.max(g1, g2);
        for (int t = 0; t < 2 && id < 0; t++) {
          int g = t == 0 ? first : last;
          if (g < 0 || t == 1 && first == last) continue;
          long w = (g == g1 ? m.w1 : 0) + (g == g2 ? m.w2 : 0), s = (long) m.w0 * m.sum[g] + less * all;
          if (v < s) break;
          if (v < (long) m.w0 * m.sum[g + 1] + (less + w) * all) id = g;
          else less += w;
        }
        if (id < 0) id = m.find((int) ((v - less * all) / m.w0));
        x[from + k] = id;
      } else id = x[from + k];
      long start = (long) m.w0 * m.sum[id], size = (long) m.w0 * (m.sum[id + 1] - m.sum[id]);
      if (g1 >= 0) { if (g1 < id) start += m.w1 * all; else if (g1 == id) size += m.w1 * all; }
      if (g2 >= 0) { if (g2 < id) start += m.w2 * all; else if (g2 == id) size += m.w2 * all; }
      low += start * r;
      range = size * r;
      while (true) {
        if (((low ^ (low + range)) >>> 56) != 0) {
          if (range >>> 48 != 0) break;
          range = -low & ((1L << 48) - 1);
        }
        if (decode) code = (code << 8) | (at < end ? buf[at++] & 255 : 0);
        else buf[at++] = (byte) (low >>> 56);
        low <<= 8;
        range <<= 8;
      }
      m.learn(id);
    }
    if (!decode) for (int i = 0; i < 8; i++) { buf[at++] = (byte) (low >>> 56); low <<= 8; }
    return at - begin;
  }

  static FileSystem files(Path p) throws Exception {
    return p.getFileSystem(org.apache.spark.deploy.SparkHadoopUtil.get().conf());
  }

  static IOException damaged(Object path, String what) { return new IOException(path + ": " + what + " is damaged"); }
}

public class QuillWriteIds implements org.apache.spark.sql.api.java.UDF5 {
  /** Writes a file: its path, the bytes before the blocks, the ids (u32), the size of the vocabulary, ids a block. Returns its length. */
  public Object call(Object path, Object head, Object raw, Object vocab, Object block) throws Exception {
    IntBuffer in = ByteBuffer.wrap((byte[]) raw).order(ByteOrder.LITTLE_ENDIAN).asIntBuffer();
    int[] x = new int[in.remaining()];
    in.get(x);
    int size = ((Integer) block).intValue();
    QuillCoder.Model m = new QuillCoder.Model(((Integer) vocab).intValue());
    byte[] buf = new byte[Math.min(size, Math.max(1, x.length)) * 6 + 16];
    Path to = new Path((String) path), part = new Path(path + "." + UUID.randomUUID() + ".part");
    FileSystem fs = QuillCoder.files(to);
    DataOutputStream out = new DataOutputStream(new BufferedOutputStream(fs.create(part, true), 1 << 16));
    long total = ((byte[]) head).length;
    out.write((byte[]) head);
    ByteBuffer mark = ByteBuffer.allocate(12).order(ByteOrder.LITTLE_ENDIAN);
    for (int i = 0; i < x.length; i += size) {
      int n = Math.min(size, x.length - i), len = QuillCoder.code(m, x, i, n, buf, 0, 0, false);
      CRC32 crc = new CRC32();
      crc.update(buf, 0, len);
      mark.clear();
      mark.putInt(n).putInt(len).putInt((int) crc.getValue());
      out.write(mark.array());
      out.write(buf, 0, len);
      total += 12 + len;
    }
    out.close();
    fs.delete(to, false);
    if (!fs.rename(part, to)) throw new IOException("can't rename " + part);
    return Long.valueOf(total);
  }

}

public class QuillReadIds implements org.apache.spark.sql.api.java.UDF1 {
  static IOException damaged(Object path, String what) { return QuillCoder.damaged(path, what); }

  /** Reads a file: an array of (doc_id, ids before, ids as bytes), in the file's order. */
  public Object call(Object path) throws Exception {
    Path from = new Path((String) path);
    FSDataInputStream in = QuillCoder.files(from).open(from);
    byte[] raw;
    try { raw = org.apache.hadoop.io.IOUtils.readFullyToByteArray(in); } finally { in.close(); }
    ByteBuffer f = ByteBuffer.wrap(raw).order(ByteOrder.LITTLE_ENDIAN);
    if (raw.length < 32 || !new String(raw, 0, 8, "ISO-8859-1").equals("%(magic)s")) throw damaged(path, "the start");
    int docs = f.getInt(8), vocab = f.getInt(12), table = f.getInt(16), open = f.getInt(20) + 24, at = open + table;
    if (docs < 0 || at < open || at + 4 > raw.length) throw damaged(path, "the header");
    CRC32 crc = new CRC32();
    crc.update(raw, 0, at);
    if ((int) crc.getValue() != f.getInt(at)) throw damaged(path, "the header");
    Inflater z = new Inflater();
    z.setInput(raw, open, table);
    byte[] t = new byte[13 * docs];
    for (int got = 0, n; got < t.length; got += n) { n = z.inflate(t, got, t.length - got); if (n <= 0) throw damaged(path, "the document table"); }
    z.end();
    ByteBuffer d = ByteBuffer.wrap(t).order(ByteOrder.LITTLE_ENDIAN);
    long all = 0;
    for (int i = 0; i < docs; i++) all += d.getInt(9 * docs + 4 * i);
    int[] x = new int[(int) all];
    QuillCoder.Model m = new QuillCoder.Model(vocab);
    int done = 0, k = 0;
    for (at += 4; at < raw.length; k++) {
      if (at + 12 > raw.length) throw damaged(path, "block " + k);
      int n = f.getInt(at), len = f.getInt(at + 4);
      if (n < 0 || len < 0 || len > raw.length - at - 12 || done + n > x.length) throw damaged(path, "block " + k);
      crc.reset();
      crc.update(raw, at + 12, len);
      if ((int) crc.getValue() != f.getInt(at + 8)) throw damaged(path, "block " + k);
      QuillCoder.code(m, x, done, n, raw, at + 12, at + 12 + len, true);
      done += n;
      at += 12 + len;
    }
    if (done != x.length) throw damaged(path, "the end");
    ArrayList rows = new ArrayList(docs);
    int s = 0;
    for (int i = 0; i < docs; i++) {
      int n = d.getInt(9 * docs + 4 * i);
      byte[] ids = new byte[4 * n];
      ByteBuffer.wrap(ids).order(ByteOrder.LITTLE_ENDIAN).asIntBuffer().put(x, s, n);
      Object id = null;
      if (d.get(8 * docs + i) != 0) id = Long.valueOf(d.getLong(8 * i));
      rows.add(RowFactory.create(new Object[] {id, Long.valueOf(s), Long.valueOf(n), ids}));
      s += n;
    }
    return rows;
  }
}
""" % {"order": ORDER, "magic": MAGIC.decode()}

def _functions(spark: SparkSession) -> None:
    jvm.register(spark, "quill_write_ids", "QuillWriteIds", CODER, "long")
    jvm.register(spark, "quill_read_ids", "QuillReadIds", CODER, "array<struct<doc_id:long,before:long,n_tokens:long,ids:binary>>")


def header(doc_ids: list, sizes: list, vocab: int) -> bytes:
    """What stands before the blocks; a doc_id may be null."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    table = zlib.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes() + np.array(sizes, "<u4").tobytes())
    note = json.dumps({"format": MAGIC.decode(), "docs": len(doc_ids), "ids": int(sum(sizes)), "vocab": vocab}).encode()
    data = MAGIC + struct.pack("<IIII", len(doc_ids), vocab, len(table), len(note)) + note + table
    return data + struct.pack("<I", zlib.crc32(data))


def store_ids(rows: DataFrame, out: str, vocab: int, block: int = BLOCK) -> list:
    """Writes one file for each row (part, seq, head, ids, n_ids, n_docs); returns the rows (file, ids, docs, bytes), in order of (part, seq)."""
    spark = rows.sparkSession
    _functions(spark)
    file = F.format_string(f"{out.rstrip('/')}/part-%06d-%06d.tok", "part", "seq")
    done = rows.select("part", "seq", file.alias("file"), F.col("n_ids").alias("ids"), F.col("n_docs").alias("docs"),
                       F.call_function("quill_write_ids", file, F.col("head"), F.col("ids"), F.lit(vocab), F.lit(block)).alias("bytes"))
    return sorted(done.collect())  # a row a file


def store_documents(docs: DataFrame, path: str, out: str, end_id: int = 2, parts: int | None = None, block: int = BLOCK, file_ids: int = FILE_IDS) -> list:
    """Encodes texts with the tokenizer at ``path`` and writes files in ascending doc_id order. Returns the files as rows.

    ``docs`` has doc_id and text, other columns are not read; null texts count as empty, null ids come first, rows with the same id are
    ordered by text, repeated rows are kept each. ``end_id`` ends each document. Ranges of doc_id are tasks; a task closes a file
    once it has ``file_ids`` ids, so that what it holds doesn't grow with the table (one very long text is in one file whatever its
    length). An empty table has no files. A task that is run again replaces its files by equal ones.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    from .unit_cache import encoder

    spark = docs.sparkSession
    spread = parts or width(spark)

    def run(batches):
        e = encoder(path, "word")
        end, part, seq = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        ids, sizes, data, held = [], [], [], 0

        def close():
            row = [[part], [seq], [header(ids, sizes, e.size)], [b"".join(data)], [held], [len(ids)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=["part", "seq", "head", "ids", "n_ids", "n_docs"])

        for b in batches:
            for at in range(0, b.num_rows, 512):
                part_ = b.slice(at, 512)
                for d, x in zip(part_.column(0).to_pylist(), e.encode([t or "" for t in part_.column(1).to_pylist()])):
                    ids.append(d)
                    sizes.append(len(x) + 1)
                    data += (x.astype("<u4").tobytes(), end)
                    held += len(x) + 1
                    if held >= file_ids:
                        yield close()
                        ids, sizes, data, held, seq = [], [], [], 0, seq + 1
        if ids:
            yield close()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    d = d.repartitionByRange(spread, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = d.mapInArrow(run, "part int, seq int, head binary, ids binary, n_ids long, n_docs long")
    return store_ids(rows, out, encoder(path, "word").size, block)


def read_documents(spark: SparkSession, files: list) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents in the files that ``store_documents`` names.

    ``start`` counts the ids before; ``ids`` is binary, an unsigned 32-bit little-endian integer an id. A damaged header or block
    fails the query.
    """
    _functions(spark)
    start, rows = 0, []
    for f in files:
        rows.append((f.file, start))
        start += f.ids
    d = spark.createDataFrame(rows, "file string, start long").repartition(max(1, len(rows)), "file")
    docs = d.select(F.col("start").alias("_start"), F.inline(F.call_function("quill_read_ids", "file")))
    return docs.select("doc_id", (F.col("_start") + F.col("before")).alias("start"), "n_tokens", "ids")


def digest_documents(spark: SparkSession, files: list) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what ``read_documents`` gives."""
    return read_documents(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
