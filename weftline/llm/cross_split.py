"""Problem 2: records of evaluation splits that appear again, exactly or almost, in the training split.

Word n-gram hashes of the evaluation records are partitioned by (subject, hash) and
the training records are scanned for hits. By the prefix rule only the rarest
n-grams of an evaluation record need to be looked up: a record contained to the
wanted degree holds at least one of them. Containment is then computed for each pair,
on words with misspellings mended.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.llm.lookalikes import skeleton
from weftline.session import cut

# Forms of address that come before a name.
TITLES = ("mr", "mrs", "ms", "miss", "dr", "sir", "lady", "lord", "captain", "major", "count", "baron", "colonel", "general", "professor", "prof", "rev", "st", "old", "the", "madame", "monsieur", "herr", "frau")

_WORDS = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class Overlap:
    """words: of an n-gram that finds candidates; short, as a misspelling in each line leaves few longer runs.
    found: share of an evaluation record's n-grams that a candidate holds at least; low, as a lead-in and a misspelling each take three or four.
    same: containment, in the longer of two texts, from which they are the same statement. held, most: containment in the shorter and in
    the longer, from which the longer is the same statement with a lead-in; a shared opening, or a short text within a far longer one, isn't.
    """

    words: int = 3
    found: float = 0.2
    same: float = 0.6
    held: float = 0.75
    most: float = 0.5


def subject_keys(name: Column) -> Column:
    """Keys of the persons a written name stands for, one for each side of a slash.

    Look-alike characters, case, blanks, forms of address and the order of the parts
    don't matter. Null and nameless values have no key.
    """
    def key(part: Column) -> Column:
        words = F.regexp_extract_all(F.lower(part), F.lit(f"({_WORDS})"))
        return F.array_join(F.array_sort(F.array_except(words, F.array(*[F.lit(t) for t in TITLES]))), " ")

    return F.array_distinct(F.filter(F.transform(F.split(skeleton(name), "/"), key), lambda k: k != ""))


def _grams(words: Column, n: int) -> Column:
    """Distinct hashes of runs of n words; a text of fewer words is one run."""
    last = F.greatest(F.size(words) - n, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, n), " "))))


@lru_cache(maxsize=1 << 19)
def _likeness(a: str, b: str) -> float:
    """Ratio of like spelling of two words from 0.7 on, else 0."""
    ratio = SequenceMatcher(None, a, b, autojunk=False).ratio()
    return ratio if ratio >= 0.7 else 0.0


@lru_cache(maxsize=1 << 18)
def _letters(word: str) -> tuple[str, int, int]:
    """(word, length, set of its letters as bits)."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return word, len(word), bits


def _maybe_like(words: list[str], spare: list[str]) -> dict[str, list[str]]:
    """Words with the spare ones that may be misspellings of them: lengths differ by two at most, and so many letters are shared that the ratio can reach 0.7."""
    out = {}
    known = [_letters(v) for v in spare]
    for w, n, bits in map(_letters, words):
        if n > 2:
            near = [v for v, m, other in known if -2 <= m - n <= 2 and 2 * min(n - (bits & ~other).bit_count(), m - (other & ~bits).bit_count()) >= 0.7 * (n + m)]
            if near:
                out[w] = near
    return out


def statement_similarity(a: str, b: str) -> float:
    """Share of the longer statement's word pairs that the other holds too, 0 to 1."""
    return statement_shares(a, b)[0]


def statement_shares(a: str, b: str, least: float = 0.0) -> tuple[float, float]:
    """Shares of the longer and of the shorter statement's word pairs that the other holds too, 0 to 1.

    Words of ``a`` that only ``b`` lacks are replaced by b's closest word of like
    spelling before pairs are compared. Sentences may stand in another order. Where not even all such words together can lift the
    first share to ``least``, it is given without them: below ``least`` either way.
    """
    wa, wb = re.findall(r"[^\W_]+", a.lower()), re.findall(r"[^\W_]+", b.lower())
    if not wa or not wb:
        return (1.0, 1.0) if wa == wb else (0.0, 0.0)
    pairs = Counter(zip(["", *wb], [*wb, ""]))
    longer, shorter = max(len(wa), len(wb)) + 1, min(len(wa), len(wb)) + 1

    def shared(words: list[str]) -> int:
        return sum(min(n, pairs[x]) for x, n in Counter(zip(["", *words], [*words, ""])).items() if x in pairs)

    plain = shared(wa)
    sa, sb = set(wa), set(wb)
    near = _maybe_like(sorted(sa - sb), sorted(sb - sa))
    if near and plain + 2 * sum(w in near for w in wa) >= least * longer:  # a mended word is in two pairs
        best = {w: max((_likeness(w, v), v) for v in vs) for w, vs in near.items()}
        plain = shared([best[w][1] if w in best and best[w][0] else w for w in wa])
    return plain / longer, plain / shorter


def _shares(least: float):
    """Shares of two columns of statements; the first is exact from ``least`` on."""

    @F.pandas_udf(StructType().add("similarity", "double").add("held", "double"))
    def shares(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statement_shares(x, y, least) for x, y in zip(a, b)], columns=["similarity", "held"], dtype="float64")

    return shares


def cross_split_overlaps(
    records: DataFrame, id_column: str, text: str, subject: str, split: str, training: str = "train", params: Overlap = Overlap()
) -> DataFrame:
    """(eval_id, train_id, eval_split, similarity) of evaluation rows that repeat a training row about the same subject.

    Evaluation rows are those with another split than ``training``; null splits take no
    part, nor do null ids, texts or subjects, nor texts without a word. Equal texts about
    the same subject are compared once, whatever their number, and so is each pair of
    different texts; every pair of ids is returned. Only n-grams within the prefix of
    an evaluation text meet training n-grams, so no pairs of a subject or of a common
    n-gram are formed as such.
    """
    rows = (
        records.select(F.expr(f"try_cast({id_column} as bigint)").alias("id"), F.col(text).alias("text"), subject_keys(F.col(subject)).alias("keys"), F.lower(F.trim(F.col(split))).alias("split"))
        .where("id is not null and text is not null and split is not null")
        .select("id", F.explode("keys").alias("subject"), "text", (F.col("split") == training).alias("train"), "split")
        .withColumn("words", F.regexp_extract_all(F.lower("text"), F.lit(f"({_WORDS})")))
        .where(F.size("words") > 0)
        .withColumn("form", F.xxhash64(F.array_join("words", " ")))
    )
    rows = cut(rows)
    texts = rows.groupBy("subject", "form", "train").agg(F.min("text").alias("text"), F.min("words").alias("words"))
    grams = texts.select("subject", "form", "train", F.explode(_grams(F.col("words"), params.words)).alias("gram"))
    trained = grams.where("train").select("subject", F.col("form").alias("train_form"), "gram")
    asked = grams.where("not train").select("subject", F.col("form").alias("eval_form"), "gram")
    often = grams.where("train").groupBy("gram").agg(F.count("*").alias("n"))
    each = Window.partitionBy("subject", "eval_form")
    rarest = (
        asked.join(often, "gram", "left")
        .withColumn("at", F.row_number().over(each.orderBy(F.coalesce("n", F.lit(0)), "gram")))
        .withColumn("of", F.count("*").over(each))
        .where(F.col("at") <= F.col("of") - F.ceil(F.col("of") * params.found) + 1)
        .select("subject", "eval_form", "gram")
    )
    pairs = rarest.join(trained, ["subject", "gram"]).select("subject", "eval_form", "train_form").distinct()
    side = lambda train, name: texts.where("train" if train else "not train").select("subject", F.col("form").alias(f"{name}_form"), F.col("text").alias(f"{name}_text"))
    same = (
        pairs.join(side(False, "eval"), ["subject", "eval_form"])
        .join(side(True, "train"), ["subject", "train_form"])
        .withColumn("shares", _shares(min(params.same, params.most))("eval_text", "train_text"))
        .select("subject", "eval_form", "train_form", "shares.*")
        .where((F.col("similarity") >= params.same) | ((F.col("held") >= params.held) & (F.col("similarity") >= params.most)))
        .select("subject", "eval_form", "train_form", "similarity")
    )
    evals = rows.where("not train").select("subject", F.col("form").alias("eval_form"), F.col("id").alias("eval_id"), F.col("split").alias("eval_split")).distinct()
    trains = rows.where("train").select("subject", F.col("form").alias("train_form"), F.col("id").alias("train_id")).distinct()
    return (
        same.join(evals, ["subject", "eval_form"]).join(trains, ["subject", "train_form"]).where("eval_id <> train_id")
        .groupBy("eval_id", "train_id", "eval_split").agg(F.max("similarity").alias("similarity"))
    )


def repeated_claims(claims: DataFrame, params: Overlap = Overlap()) -> DataFrame:
    """Overlaps of claim_rows by content and char."""
    return cross_split_overlaps(claims, "id", "content", "char", "split", params=params)


def overlap_report(claims: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(split, book_name, overlapping_rows, overlapping_pairs) of the evaluation side; book_name in lower case with single blanks."""
    books = claims.select(F.expr("try_cast(id as bigint)").alias("eval_id"), F.trim(F.regexp_replace(F.lower("book_name"), r"(?U)\s+", " ")).alias("book_name")).where("eval_id is not null")
    books = books.groupBy("eval_id").agg(F.min("book_name").alias("book_name"))
    return (
        overlaps.join(books, "eval_id").groupBy(F.col("eval_split").alias("split"), "book_name")
        .agg(F.countDistinct("eval_id").alias("overlapping_rows"), F.count("*").alias("overlapping_pairs"))
    )
