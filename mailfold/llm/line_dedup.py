"""Line dedup by winnowing over line hashes (dealt operator 8), in DataFrame functions only.

The lines of a document that are not blank, each as a 64-bit hash, form a sequence.  Every
window of ``RUN`` consecutive hashes selects its minimum, the rightmost on a tie, as a
fingerprint; a run of RUN or more lines that occurs twice is therefore sure to hold a
fingerprint at the same place in both.  Occurrences of a fingerprint are joined where their
windows agree around it, each with the first such occurrence rather than with every other
one, so a passage of any number of copies costs one row a window.  As the windows of a
longer run follow each other line by line, taking all windows that match extends a match to
its full length both ways.  A line of ``LONG_WORDS`` words or more is a window of its own as well.

The earliest occurrence, by document id, then a hash of the text, then line, stays; the
lines of all later ones go.  Within a document a window counts as a repetition only if it
does not overlap the first occurrence.  Blank lines and runs shorter than RUN stay.

Defined results: a null text stays null and an empty one empty; a document may lose all its
lines and then has an empty text; rows of the same id and text count as one document and
are treated alike; a null id sorts first; other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailfold.llm.common import free_names
from mailfold.session import settle

#: Lines in a window: the shortest run that is sure to be found, and the shortest removed.
RUN = 2
#: Words from which a single line is a passage, found and removed alone.
LONG_WORDS = 50


def _windows(docs: DataFrame, id_col: str, text_col: str, run: int, long_words: int) -> DataFrame:
    """One row for each window: document, first place, length, fingerprint, its offset, two
    hashes of the window's content, and the numbers of its lines."""
    numbered = F.transform(F.split(text_col, "\n", -1), lambda line, i: F.struct(i.alias("n"), F.xxhash64(F.trim(line)).alias("h"),
                                                                               F.size(F.split(F.trim(line), " ", -1)).alias("words"),
                                                                               (F.trim(line) == "").alias("blank")))
    sequence = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("version"), F.filter(numbered, lambda x: ~x["blank"]).alias("lines"))
    places = F.when(F.size("lines") >= run, F.sequence(F.lit(0), F.size("lines") - run)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(places, lambda i: F.struct(i.alias("start"), F.lit(run).alias("size")))
    marked = F.transform("lines", lambda x, i: F.struct(F.when(x["words"] >= long_words, i).alias("start"), F.lit(1).alias("size")))
    alone = F.filter(marked, lambda x: x["start"].isNotNull())
    starts = sequence.select("doc", "version", "lines", F.explode(F.concat(runs, alone) if run > 1 else runs).alias("at"))
    window = starts.select("doc", "version", "at.start", "at.size", F.slice("lines", F.col("at.start") + 1, F.col("at.size")).alias("window"))
    hashes = F.col("window.h")
    least = F.array_min(hashes)
    return window.select(
        "doc", "version", "start", "size", least.alias("fingerprint"),
        (F.col("size") - F.array_position(F.reverse(hashes), least)).cast("int").alias("offset"),
        F.xxhash64(hashes).alias("content"), F.xxhash64(hashes, F.lit("second")).alias("content2"),
        F.col("window.n").alias("numbers"),
    )


KEY = ("size", "fingerprint", "offset", "content", "content2")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN,
                   long_words: int = LONG_WORDS) -> DataFrame:
    """(doc, version, numbers): the lines to delete of every document that has some."""
    windows = settle(_windows(docs, id_col, text_col, run, long_words), "llm-windows")
    place = F.struct("doc", "version", "start")
    firsts = windows.groupBy(*KEY).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    firsts = settle(firsts, "llm-first-windows")
    elsewhere: Column = ~(F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("version") == F.col("first.version")))
    matched = windows.join(firsts, list(KEY)).where(elsewhere | (F.col("start") >= F.col("first.start") + F.col("size")))
    lines = matched.select("doc", "version", F.explode("numbers").alias("number"))
    return lines.groupBy("doc", "version").agg(F.collect_set("number").alias("numbers"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN,
                    long_words: int = LONG_WORDS, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` without the lines of later repeated runs; ``counts`` names columns to add for the
    numbers of lines and of removed lines, which ``docs`` must not have yet."""
    if counts and set(counts) & set(docs.columns):
        raise ValueError(f"columns {counts} exist")
    doc, version, numbers, own = free_names(docs.columns, "doc", "version", "numbers", "own")
    gone = settle(repeated_lines(docs, id_col, text_col, run, long_words), "llm-repeated-lines").toDF(doc, version, numbers)
    lined = docs.withColumn(own, F.xxhash64(text_col)).withColumn(text_col, F.split(text_col, "\n", -1))
    # Documents with repeats grow with the input, so this is a sort-merge join at every size.
    joined = lined.join(gone.hint("merge"), F.col(id_col).eqNullSafe(F.col(doc)) & (F.col(own) == F.col(version)), "left")
    lines = F.col(text_col)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(numbers)), lambda i: lines[i])
    text = F.array_join(F.when(F.col(numbers).isNull(), lines).otherwise(kept), "\n")
    sizes = (F.coalesce(F.size(c), F.lit(0)).cast("bigint") for c in (lines, F.col(numbers)))
    extra = [size.alias(name) for size, name in zip(sizes, counts or ())]
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], *extra)


def oracle_sql(run: int = RUN, long_words: int = LONG_WORDS) -> str:
    """The same rows in SQL: windows compared by their text instead of by fingerprints."""
    window = " || chr(10) || ".join(f"lead(t, {i}) OVER w" if i else "t" for i in range(run))
    numbers = ", ".join(f"lead(n, {i}) OVER w" if i else "n" for i in range(run))
    return f"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS n FROM split),
seq AS (SELECT doc_id, n, trim(line, ' ') AS t, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS p
        FROM numbered WHERE trim(line, ' ') <> ''),
win AS (SELECT doc_id, p, {run} AS size, {window} AS content, [{numbers}] AS numbers FROM seq
        WINDOW w AS (PARTITION BY doc_id ORDER BY p)
        UNION ALL SELECT doc_id, p, 1, t, [n] FROM seq WHERE {run} > 1 AND len(string_split(t, ' ')) >= {long_words}),
placed AS (SELECT *, first_value(doc_id) OVER f AS first_doc, first_value(p) OVER f AS first_p FROM win WHERE content IS NOT NULL
           WINDOW f AS (PARTITION BY size, content ORDER BY doc_id, p)),
gone AS (SELECT DISTINCT doc_id, unnest(numbers) AS n FROM placed WHERE doc_id <> first_doc OR p >= first_p + size),
kept AS (SELECT numbered.doc_id, string_agg(line, chr(10) ORDER BY numbered.n) FILTER (WHERE gone.n IS NULL) AS text,
                count(*) AS n_lines, count(gone.n) AS n_removed
         FROM numbered LEFT JOIN gone USING (doc_id, n) GROUP BY ALL)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)"""
