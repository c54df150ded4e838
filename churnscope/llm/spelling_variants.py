"""Grouping of spelling variants by a relational walk over a trie.

Two words are near if exactly one inserted, deleted or replaced code point
turns one into the other.  All words are kept in a trie that is a table: a row
per node with its children (letter, child node, letters that may follow there;
the end of a word is a letter too).  States (word, position, node, edits) are
joined with that table level by level, and states that have used their one edit
when the word ends are neighbours.

* States without an edit need no join: they stand on the word's own nodes.
* Every pair is found from one side: by the deletion in the longer word (of the
  last letter of a run of equal ones, since all of them give the same word), or
  by the replacement with the greater letter.
* Edits in the second half of a word are looked for in the trie of the words,
  edits in the first half in the trie of the words read backwards; both are in
  one table.  So no state starts at the first letters, where a node has nearly
  all words under it and all letters as children.
* A state starts where the node has another child that fits the edit, and goes
  on only if the child can be followed by the word's next letter.

A node is a 64-bit hash of its prefix and direction.  Equal hashes of two nodes
could only let a state live on by mistake: a neighbour counts when the edited
word, as text, is one of the words.  That is also how words with more than
``LEVELS`` letters after the edit end: what is left of them is compared in one
step.

``word_counts`` gives the words of documents, ``near_words`` the pairs,
``forms`` each word's standard form and the last one of the chain of forms (by
pointer doubling; every step of a chain multiplies the count by ``ratio``, so
chains are short).

Defined cases: a NULL text has no words; a NULL id is written as nothing;
repeated rows are further occurrences; a word without neighbours has none; ties
of the count go to the smaller word in code-point order; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.llm.storage import stored
from churnscope.llm.text_arrays import mix, powers, slices

MIN_LENGTH = 7
LEVELS = 24
SLICE_BYTES = 1 << 20
_U = np.uint64

# A run of a-z and U+00C0-U+00FF in UTF-8 (lead byte C3).
_LETTER = rb"(?:[a-z]|\xc3[\x80-\xbf])"

Respell = Callable[["int | None"], Callable[[bytes], bytes]]


def word_counts(
    docs: DataFrame, min_length: int = MIN_LENGTH, respell: Respell | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(word, n): runs of ``[A-Za-z\\u00C0-\\u00FF]`` of at least ``min_length``
    code points, A-Z lower-cased, and their occurrences.  ``respell(doc_id)``
    may give a function that changes a document's runs before they are counted;
    a run must not grow."""
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    runs = re.compile(_LETTER + b"{%d,}" % max(1, min_length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                total: Counter[bytes] = Counter()
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                    found = runs.findall(text.lower())  # bytes: A-Z only
                    if respell:
                        change = respell(doc_id)
                        for word, n in Counter(found).items():
                            total[change(word)] += n
                    else:
                        total.update(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"]
                )

    counts = source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.char_length("word") >= min_length)


_STEPS = "wid long, back boolean, at int, spawns boolean, node long, letter int, child long, follows int, then int"


def _steps(min_length: int):
    """A row per place of a word in both directions: the node before the letter
    and after it, and the two letters that follow (0: the end of the word)."""
    least = min_length // 2

    def one_way(words: list[str], wids: np.ndarray, back: bool) -> list[np.ndarray]:
        codes = np.frombuffer("".join(f"{w[::-1] if back else w}\0" for w in words).encode("utf-32-le"), np.uint32)
        length = np.fromiter((len(w) for w in words), np.int64, len(words))
        start = np.cumsum(length + 1) - length - 1
        owner = np.repeat(np.arange(len(words)), length + 1)
        at = np.arange(len(codes)) - start[owner]
        sums = np.zeros(len(codes) + 1, _U)
        np.cumsum(mix(codes.astype(_U) + _U(1)) * powers(int(length.max(initial=0)) + 2)[at], out=sums[1:])
        before = sums[:-1] - sums[start[owner]]
        salt = _U(0x632BE59BD9B4E019 if back else 0)
        node = mix((before + at.astype(_U)) ^ salt)
        shifted = np.concatenate((codes, np.zeros(2, np.uint32)))
        ends = at == length[owner]
        child = np.where(ends, _U(0), np.concatenate((node[1:], np.zeros(1, _U))))
        follows = np.where(ends, 0, shifted[1:-1])
        then = np.where(at >= length[owner] - 1, 0, shifted[2:])
        half = (length[owner] + back) // 2
        keep = at >= least
        columns = (wids[owner], np.full(len(codes), back), at.astype(np.int32), (at >= half) & ~ends, node.view(np.int64), codes.view(np.int32),
                   child.view(np.int64), follows.astype(np.int32), then.astype(np.int32))
        return [c[keep] for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in _STEPS.split(", ")]
        for batch in batches:
            for part in slices(batch, "word", SLICE_BYTES >> 2):
                words, wids = part.column("word").to_pylist(), part.column("wid").to_numpy()
                for back in (False, True):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in one_way(words, wids, back)], names)

    return run


def _bit(letter: Column | str) -> Column:
    """A letter's bit in a set of letters."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col(letter) if isinstance(letter, str) else letter) % 63)


def _in(letters: Column, letter: Column) -> Column:
    return letters.bitwiseAND(_bit(letter)) != 0


def _first_code(text: Column) -> Column:
    """Code point of the first letter, 0 for the empty string."""
    return F.ascii(F.substring(text, 1, 1))


def near_words(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Pairs (word, n, near, near_n), in both directions, of near words among
    the distinct ``words`` (word, n), which have ``min_length`` code points or
    more."""
    spark = words.sparkSession
    words = words.select("word", "n", F.xxhash64("word").alias("wid"))
    steps = words.select("word", "wid").mapInArrow(_steps(min_length), _STEPS)
    edges = steps.groupBy("node", "letter").agg(F.first("child").alias("child"), F.bit_or(_bit("follows")).alias("follows"))
    # a row per node: its children are at most the alphabet and the end
    trie = stored(edges.groupBy("node").agg(F.collect_list(F.struct("letter", "child", "follows")).alias("kids")), "trie")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Every level joins the frontier with this table: it is dealt out by node once.
    trie = trie.repartition(parts, "node").persist(StorageLevel.DISK_ONLY)

    starts = steps.where("spawns").select("wid", "back", "at", "node", "letter", "follows", "then")
    forks = trie.where(F.size("kids") > 1)
    own, kid = F.col("letter"), F.col("kid.letter")
    deleted = (kid == F.col("follows")) & (kid != own) & _in(F.col("kid.follows"), F.col("then"))
    replaced = (kid > own) & _in(F.col("kid.follows"), F.col("follows"))
    edits = F.array_compact(F.array(F.when(deleted, F.lit(0)), F.when(replaced, kid)))
    spawned = starts.join(forks, "node").select("wid", "back", "at", "letter", "follows", "then", F.explode("kids").alias("kid"))
    spawned = spawned.select("wid", "back", "at", F.col("kid.child").alias("node"), F.explode(edits).alias("put"))

    met = spawned.join(words, "wid")
    key = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    gone = F.col("put") == 0
    letter = F.when(gone, "").otherwise(F.call_function("char", F.col("put")))
    tail = F.substring(F.col("key"), F.col("at") + 2, F.length("key"))
    met = met.withColumn("key", key).withColumn("edited", F.concat(F.substring("key", F.lit(1), F.col("at")), letter, tail))
    frontier = met.select(
        "word", "n", F.when(F.col("back"), F.reverse("edited")).otherwise(F.col("edited")).alias("near"), "node",
        F.when(gone, F.substring(tail, 2, 1 << 30)).otherwise(tail).alias("rest"),
    )

    ended = []
    for level in range(LEVELS + 1):
        frontier = stored(frontier, "trie-frontier")
        ended.append(frontier.where("rest = ''" if level < LEVELS else "true").select("word", "n", "near"))
        going = frontier.where("rest <> ''")
        if level == LEVELS or not going.limit(1).count():
            break
        going = going.join(trie, "node").withColumn("kid", F.explode(F.filter("kids", lambda k: k.letter == _first_code(F.col("rest")))))
        going = going.select("word", "n", "near", F.col("kid.child").alias("node"), F.expr("substring(rest, 2)").alias("rest"), F.col("kid.follows").alias("follows"))
        frontier = going.where(_in(F.col("follows"), _first_code(F.col("rest")))).drop("follows")
    found = ended[0]
    for more in ended[1:]:
        found = found.unionByName(more)
    real = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = stored(found.distinct().join(real, "near").select("word", "n", "near", "near_n"), "near-words")
    trie.unpersist()
    turned = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.unionByName(turned)


def forms(words: DataFrame, pairs: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all ``words``.  A word's form is
    its near word of largest count, if that is at least ``ratio`` times its own;
    its root the last of the chain of forms that starts with it."""
    most = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    best = pairs.groupBy("word").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("n_near"), most.alias("best"))
    taken = -F.col("best.less") >= F.col("n") * ratio
    best = stored(
        best.select("word", "n_near", F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")),
        "spelling-forms",
    )
    links = best.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = links.select(F.col("word").alias("at"), F.col("root").alias("further"))
        links = stored(
            links.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "spelling-roots",
        )
        if not links.where("moved").limit(1).count():
            break
    done = words.join(best, "word", "left").join(links.drop("moved"), "word", "left")
    return done.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")
    )
