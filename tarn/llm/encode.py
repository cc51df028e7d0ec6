"""Problem 6: encoding the corpus with a public byte-level BPE tokenizer.

DuckDB encodes inside each Arrow partition. Texts are split into words; each distinct word's bytes are
token-position rows that a recursive query joins with the merge table and contracts until nothing
merges any more; an ordered aggregation puts each document's ids together. A task runs the recursion
once for each word it sees and keeps the result.

A very long word is contracted in pieces, which are then joined: the tokens around each cut are contracted
anew, and more of them until the first and the last come out as they were. A sequence in which every two
neighbours are what their bytes encode to is the encoding of the whole, so the ids are the same.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarn.llm.canon import as_type
from tarn.llm.duck import connect, map_text, text_table

#: Folder of the vocabulary files, and the file of the vocabulary used by default.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: Words whose ids a task keeps; beyond it starts anew, so its memory is bounded.
KEPT_WORDS = 1_000_000
#: Bytes of a word beyond which it is contracted in pieces, bytes of a piece, and tokens on either side of a cut that are contracted anew at first.
LONG_WORD, PIECE, SEAM = 2048, 64, 8

# Fixed value: the white space of the pattern that splits texts into words.
_WS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, merges)``: the id of each of the 256 bytes, and rows ``(left, right, merged)`` in order of rank."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab = model["vocab"]
    # bytes that print as themselves stand for themselves, the others for the characters from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ids = np.array([vocab[names[b]] for b in range(256)], dtype=np.int32)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return ids, np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], dtype=np.int32)


def _words_sql(separator: str) -> str:
    """Texts as lists of words. RE2 can't look ahead, so ``separator`` first marks where white space before a word loses its last character.

    The separator, which no text holds, is then the end of a word of its own or of a space's, and is taken off.
    """
    word = rf"''(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+"
    return rf"""SELECT k, CASE WHEN ends_with(w, '{separator}') THEN left(w, length(w) - {len(separator)}) ELSE w END AS w, pos FROM (SELECT k, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM
        (SELECT k, regexp_extract_all(regexp_replace(x, '([{_WS}]+)([{_WS}][^{_WS}])', '\1{separator}\2', 'g'), '{word}') AS words FROM t)) WHERE w <> '{separator}'"""


#: Contracts the words of ``fresh`` (wid, h: their bytes in hexadecimal) to a fixpoint. Only the last state of each position is held; a token that went into
#: the one before is null. The number of the step lets every row of a word that isn't done take part in the next step.
_MERGE = """
WITH RECURSIVE step(wid, pos, tok, it) USING KEY (wid, pos) AS (
    SELECT wid, pos, b.id, 0
    FROM (SELECT wid, h, unnest(range(len(h) // 2)) AS pos FROM fresh) f JOIN byte_ids b ON b.h = substr(f.h, 2 * f.pos::INT + 1, 2)
  UNION
    SELECT wid, pos, CASE WHEN coalesce(lag(taken) OVER (PARTITION BY wid ORDER BY pos), false) THEN NULL WHEN taken THEN best ELSE tok END, it + 1
    FROM (
        -- of the pairs that share a token with the one before, every second is taken, from the left
        SELECT *, hit AND (row_number() OVER (PARTITION BY wid, hit, island ORDER BY pos)) % 2 = 1 AS taken FROM (
            SELECT *, n - row_number() OVER (PARTITION BY wid, hit ORDER BY pos) AS island FROM (
                SELECT *, merged IS NOT NULL AND merged = best AS hit FROM (
                    SELECT p.*, m.merged, arg_min(m.merged, m.rank) OVER (PARTITION BY wid) AS best
                    FROM (SELECT wid, pos, tok, it, lead(tok) OVER o AS following, row_number() OVER o AS n FROM step WHERE tok IS NOT NULL WINDOW o AS (PARTITION BY wid ORDER BY pos)) p
                    LEFT JOIN merges m ON m.a = p.tok AND m.b = p.following)
                WHERE best IS NOT NULL))))
SELECT wid, list(tok ORDER BY pos) AS ids FROM step WHERE tok IS NOT NULL GROUP BY wid
"""


class Encoder:
    """One task's database: the merge table, and the ids of the words met so far."""

    def __init__(self, ids: np.ndarray, merges: np.ndarray, kept: int = KEPT_WORDS):
        self.db, self.kept = connect(), kept
        self.db.register("a", pa.table({"h": [f"{b:02X}" for b in range(256)], "id": pa.array(ids)}))
        self.db.register("b", pa.table({"a": merges[:, 0], "b": merges[:, 1], "merged": merges[:, 2], "rank": pa.array(np.arange(len(merges), dtype=np.int32))}))
        self.db.execute("CREATE TABLE byte_ids AS FROM a; CREATE TABLE merges AS FROM b; CREATE TABLE known (w VARCHAR, ids INTEGER[])")
        self.db.unregister("a")
        self.db.unregister("b")
        self.count = 0
        self.sizes = np.zeros(int(max(ids.max(), merges.max(initial=0))) + 1, np.int64)  # bytes of each token
        self.sizes[ids] = 1
        for left, right, merged in merges:
            self.sizes[merged] = self.sizes[left] + self.sizes[right]

    def _separator(self) -> str:
        """A private-use character as often as it takes to be in none of the texts."""
        separator = ""
        while self.db.execute("SELECT bool_or(contains(x, ?)) FROM t", [separator]).fetchall()[0][0]:
            separator += separator
        return separator

    def _contract(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of words given as bytes."""
        self.db.register("w", pa.table({"wid": pa.array(range(len(words)), pa.int64()), "h": [w.hex().upper() for w in words]}))
        self.db.execute("CREATE OR REPLACE TEMP TABLE fresh AS FROM w")
        self.db.unregister("w")
        ids = as_type(self.db.sql(f"SELECT ids FROM ({_MERGE}) ORDER BY wid").to_arrow_table().column("ids"), pa.list_(pa.int32()))
        return np.split(ids.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(ids).to_numpy())[:-1])

    def _contract_long(self, word: bytes) -> np.ndarray:
        """The ids of one long word: pieces of it, then ever two of their results joined."""
        places = list(range(0, len(word), PIECE))
        pieces = self._contract([word[i : i + PIECE] for i in places])
        while len(pieces) > 1:
            joined: list[np.ndarray | None] = [None] * (len(pieces) // 2)
            cuts = places[1::2]
            width, open_ = SEAM, list(range(len(joined)))
            while open_:
                seams = []
                for j in open_:
                    left, right = pieces[2 * j][-width:], pieces[2 * j + 1][:width]
                    seams.append(word[cuts[j] - int(self.sizes[left].sum()) : cuts[j] + int(self.sizes[right].sum())])
                rest = []
                for j, ids in zip(open_, self._contract(seams)):
                    left, right = pieces[2 * j], pieces[2 * j + 1]
                    if (len(left) <= width or ids[0] == left[-width]) and (len(right) <= width or ids[-1] == right[width - 1]):
                        joined[j] = np.concatenate([left[:-width], ids, right[width:]])
                    else:
                        rest.append(j)
                width, open_ = 4 * width, rest
            pieces, places = joined + pieces[len(joined) * 2 :], places[::2]
        return pieces[0]

    def encode(self, batch: pa.RecordBatch, column: str) -> pa.Array:
        """The ids of each text of a batch; none of null and empty texts."""
        db = self.db
        db.register("t", text_table(batch, column))
        db.execute(f"CREATE OR REPLACE TEMP TABLE placed AS {_words_sql(self._separator())}")
        db.unregister("t")
        if self.count > self.kept:
            db.execute("DELETE FROM known")
            self.count = 0
        db.execute(
            "CREATE OR REPLACE TEMP TABLE fresh AS SELECT row_number() OVER () AS wid, w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM placed ANTI JOIN known USING (w))"
        )
        self.count += db.sql("SELECT count(*) FROM fresh").fetchall()[0][0]
        long = [w for (w,) in db.sql(f"SELECT w FROM fresh WHERE len(h) > {2 * LONG_WORD}").fetchall()]
        if long:
            db.execute(f"DELETE FROM fresh WHERE len(h) > {2 * LONG_WORD}")
        db.execute(f"INSERT INTO known SELECT w, ids FROM ({_MERGE}) JOIN fresh USING (wid)")
        for word in long:
            ids = self._contract_long(word.encode())
            db.register("w", pa.table({"w": [word], "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, pa.int32()))}))
            db.execute("INSERT INTO known SELECT w, ids FROM w")
            db.unregister("w")
        out = db.sql("SELECT k, flatten(list(ids ORDER BY pos)) AS ids FROM placed JOIN known USING (w) GROUP BY k ORDER BY k").to_arrow_table()
        if long:  # they would take the place of thousands of other words
            db.execute(f"DELETE FROM known WHERE octet_length(encode(w)) > {LONG_WORD}")
        lists = as_type(out.column("ids"), pa.list_(pa.int32()))
        # texts without words have no row: their lists start and end where the next one starts
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        sizes[out.column("k").to_numpy()] = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), lists.flatten())


def encode(df: DataFrame, text: str = "text", output: str = "ids", tokenizers: str = TOKENIZERS, file: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``output``: the token ids of ``text``, without special tokens.

    Null and empty texts have the empty list. Strings that spell special tokens are ordinary text. Very
    long texts and words are encoded like others. Repeated rows give repeated rows; an existing column
    ``output`` is replaced, other columns may have any names. An empty table gives an empty table.
    """
    ids, merges = vocabulary(f"{tokenizers}/{file}")
    shipped = df.sparkSession.sparkContext.broadcast((ids, merges))  # one vocabulary file, whatever the corpus

    def compute():
        encoder = Encoder(*shipped.value)
        return lambda batch: [encoder.encode(batch, text)]

    return map_text(df, text, [T.StructField(output, T.ArrayType(T.IntegerType()))], compute, keep=keep)
