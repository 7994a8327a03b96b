"""Problem 5: linking the spellings of a name to the entity they refer to.

Merge-and-rematch: an entity's profile begins with the words of its canonical name. Spellings that
match a profile are merged into it, and each of their words joins the others that stand for the same word of the name; the richer
profile, in which a given name of one spelling and a family name of another now stand together, goes back into blocking and meets the spellings that are left, until a round
merges nothing. The first round blocks by (narrative, whole word), the others also by words with letters left out, never by a
whole narrative.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from weftline.llm.cross_split import TITLES
from weftline.llm.lookalikes import LOOKALIKES, skeleton_of
from weftline.session import cut

# Short forms of given names, and words short forms of which occur in other names.
NICKNAMES = {
    "albert": "al bert bertie", "alexander": "alex alec sandy xander lex sasha", "alexandra": "alex sandra", "alfred": "alf alfie fred", "alice": "ally", "andrew": "andy drew",
    "anthony": "tony ant", "arthur": "art artie", "augustus": "gus augie", "beatrice": "bea trixie", "benedict": "ben benny", "benjamin": "ben benny", "caroline": "carrie caro",
    "catherine": "cathy kate katie cat kitty", "charles": "charlie chuck chas", "charlotte": "lottie charlie", "christina": "tina chris", "christopher": "chris kit topher",
    "daniel": "dan danny", "david": "dave davy", "dorothy": "dot dottie dolly dora", "edmund": "ed ned eddie", "edward": "ed eddie ned ted teddy", "eleanor": "ellie nell nora nellie",
    "elizabeth": "liz lizzie beth betty bess eliza betsy lisa libby", "emily": "em emmy millie", "florence": "flo florrie", "francis": "frank fran frankie", "frances": "fran fanny frankie",
    "frederick": "fred freddie freddy fritz", "george": "georgie", "gwendolyn": "gwen wendy", "harriet": "hattie harry", "helen": "nell nellie", "henry": "harry hank hal", "isabella": "bella izzy belle ella isa ibby",
    "jacob": "jake", "james": "jim jimmy jamie jem", "jane": "janie jenny", "john": "jack johnny jon", "jonathan": "jon jonny", "joseph": "joe joey jo", "josephine": "jo josie posy fifi",
    "katherine": "kate kathy katie kitty kat kit", "lawrence": "larry laurie", "leonard": "len lenny leo", "lucy": "lu", "margaret": "maggie meg peggy greta madge daisy marge", "martha": "mattie patty marty",
    "mary": "molly polly mae mamie", "matilda": "tilly mattie maud tilda", "matthew": "matt matty", "michael": "mike mick mickey", "nathaniel": "nat nate nathan", "nicholas": "nick nicky", "patrick": "pat paddy",
    "peter": "pete", "philip": "phil pip", "philippa": "pip pippa", "rebecca": "becky becca bec", "richard": "rick dick richie rich dickie", "robert": "bob rob bobby robbie bert", "rosalind": "ros rosie", "samuel": "sam sammy",
    "sarah": "sally sadie", "sebastian": "seb bastian", "simon": "si", "sophia": "sophie", "stephen": "steve stevie", "susannah": "sue susie sukie susan", "theodore": "ted teddy theo", "theresa": "tess terry", "thomas": "tom tommy",
    "timothy": "tim timmy", "ursula": "ursie", "victoria": "vicky tori", "walter": "walt wally", "wilhelmina": "mina minnie willa billie", "william": "bill billy will willie liam", "winifred": "winnie freda", "zachary": "zach zack zac zed",
}
SHORT_FORMS = {"mt": "mount", "st": "saint", "corp": "corporation", "co": "company", "ltd": "limited", "inc": "incorporated", "assoc": "association", "assn": "association", "soc": "society", "inst": "institute", "bros": "brothers", "pt": "port", "ft": "fort", "hts": "heights", "cas": "castle", "hbr": "harbour", "n": "northern", "s": "southern", "univ": "university", "dept": "department"}
PARTICLES = frozenset("de von van der den del di da la le du of and".split())
GENERIC = frozenset(
    "i he she it they we you him her his hers my our their your this that a an some two three one old young other captain stranger prisoner sailor guests guest father mother brother sister son daughter friend man woman lord lady lordship ladyship ship boy girl servant master mistress uncle aunt cousin husband wife crew doctor visitor traveller narrator author people men women child children king queen house village".split()
)
_ADDRESS = frozenset(t for t in TITLES if t != "st") | {"count", "countess", "old", "young", "dame", "master", "mister", "widow", "squire", "father", "sergeant", "lieutenant", "judge"}
_BACK = {base: others for base, others in LOOKALIKES.items() if base.isalpha()}


@dataclass(frozen=True)
class Linking:
    """least: score from which a spelling matches. lead: by which the best profile must lead."""

    least: float = 2.0
    lead: float = 0.25


def _plain(text: str) -> str:
    """Lower case without accents; look-alikes resolved into the script most letters are of."""
    if text.isascii():
        return text.lower()
    cyrillic = sum("Ѐ" <= c <= "ӿ" for c in text)
    latin = sum(c.isascii() and c.isalpha() for c in unicodedata.normalize("NFKD", text))
    if cyrillic and cyrillic >= latin:
        text = "".join(next((o for o in _BACK[c] if "Ѐ" <= o <= "ӿ"), c) if c in _BACK else c for c in unicodedata.normalize("NFKC", text))
        text = "".join(c for c in text if unicodedata.category(c) != "Cf").lower()
        return text
    text = unicodedata.normalize("NFD", (skeleton_of(text) or "").lower())
    return "".join(c for c in text if not unicodedata.combining(c))


@lru_cache(maxsize=200_000)
def words_of_name(name: str) -> tuple[str, ...]:
    """Telling words of a name: without forms of address, articles, particles and quotes; short forms written out.

    'Family, Given' is turned round. Letters after which a full stop or nothing comes stay as initials.
    """
    text = _plain(name).replace("'", "")
    if text.count(",") == 1:
        last, first = text.split(",")
        text = f"{first} {last}"
    words = re.findall(r"[^\W_]+", text)
    kept = [w for w in words if w not in _ADDRESS and w not in PARTICLES]
    out = [SHORT_FORMS.get(w, w) if len(w) > 1 else w for w in kept]
    return tuple(out or [w for w in words if w not in PARTICLES and w != "the"][:1])


def is_generic(name: str) -> bool:
    """A pronoun or a description that names nobody."""
    words = re.findall(r"[^\W_]+", _plain(name))
    return not words or all(w in GENERIC or w == "the" for w in words)


@lru_cache(maxsize=400_000)
def _near(a: str, b: str) -> bool:
    """Whether two different words are misspellings of one another: one edit, two in words of seven letters.

    An edit puts in, leaves out or changes a letter, or exchanges neighbours.
    """
    longest = max(len(a), len(b))
    allowed = 0 if longest < 4 else 1 if longest < 7 else 2
    if abs(len(a) - len(b)) > allowed:
        return False
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > allowed:
            return False
        before, last = last, row
    return last[-1] <= allowed


@lru_cache(maxsize=200_000)
def _short_for(short: str, full: str) -> bool:
    """Whether ``short`` is a short form of the given name ``full``: a known one, its beginning, or a contraction."""
    if short in NICKNAMES.get(full, "").split():
        return True
    if len(short) < 3 or short[0] != full[0]:
        return False
    stem = re.sub(r"(ie|y|i)$", "", short)
    return (len(short) < len(full) and full.startswith(short)) or (len(stem) >= 2 and stem != short and full.startswith(stem)) or _contracted(short, full)


def _contracted(short: str, full: str) -> bool:
    """Whether ``short`` is ``full`` with letters between the first and the last left out."""
    if not 3 <= len(short) <= min(5, len(full) - 2) or short[0] != full[0] or short[-1] != full[-1]:
        return False
    rest = iter(full)
    return all(c in rest for c in short)


def _stray(word: str, canonical: str) -> bool:
    """A misspelled particle of a name that has one."""
    return len(word) <= 4 and (len(word) > 1 or word in "fo") and any(q in PARTICLES and (set(word) & set(q) or len(word) > 2) for q in canonical.lower().split())


Slots = tuple[tuple[str, ...], ...]


@lru_cache(maxsize=100_000)
def _slots(form: str) -> Slots:
    """A profile's words out of 'slot:word' items: for each word of the canonical name that word, then those that stood for it."""
    out: dict[int, list[str]] = {}
    for item in form.split():
        k, w = item.split(":")
        out.setdefault(int(k), []).append(w)
    return tuple(tuple(out[k]) for k in sorted(out))


def _fit(w: str, variants: tuple[str, ...], first: bool, given: bool, only: bool, many: bool) -> float:
    """How well a word fits one word of a profile. given: that word is the given name, first: or that is borne out; only: the spelling has no other word; many: the name has several."""
    if len(w) == 1:
        return (1.2 if first else 0.7) if any(x[0] == w for x in variants) else 0.0
    if w in variants:
        return 3.0
    whole = [x for x in variants if len(x) > 1]
    if given and many and any(_short_for(w, x) for x in whole):
        return 2.0
    if any(_near(w, x) for x in whole):
        return 2.5
    if not only and any(_contracted(w, x) for x in whole):
        return 1.6
    return 1.2 if w[0] in variants else 0.0


def profile_score(m: tuple[str, ...], slots: Slots, canonical: str) -> tuple[float, list[tuple[int, str]]]:
    """(score, learnt words): how well a spelling's words fit a profile, 0 not at all, 2 by the family name only, more for each word it bears out.

    Every word of the spelling must be a word of the profile, one misspelled, its initial, or a
    short form of the given name, and the last word of the name or all words but the
    last of a longer title must be borne out. Learnt: (slot, word) of words that are new to their slot.
    """
    e = tuple(v[0] for v in slots)
    if not m or not e:
        return 0.0, []
    if m == e:
        return 50.0, []
    joined, whole = "".join(m), "".join(e)
    if sorted(m) == sorted(e) or joined == whole:
        return 45.0, []
    if len(e) >= 3 and len(joined) == len(e) and all(w[0] == c for w, c in zip(e, joined)) and (len(m) == 1 or all(len(w) == 1 for w in m)):
        return 12.0, []
    if len(joined) >= 6 and (len(m) == 1 or len(e) == 1) and _near(joined, whole):
        return 40.0, [(0, joined)] if len(m) == len(e) == 1 else []
    free = list(range(len(e)))
    total, borne, exact, learnt = 0.0, set(), 0, []
    for w in sorted(m, key=len, reverse=True):
        best, at = 0.0, -1
        for k in free:
            s = _fit(w, slots[k], k == 0 or 0 in borne, k == 0, len(m) == 1, len(e) > 1)
            if not s and 2 <= len(w) <= 4 and len(m) > 1 and len(e) > 2 and w == "".join(x[0] for x in e[: len(w)]):
                s = 2.4
            if s and (s > best or (s == best and k == len(e) - 1)):
                best, at = s, k
        if at < 0:
            if len(m) > 2 and _stray(w, canonical):
                continue
            return 0.0, []
        free.remove(at)
        borne.add(at)
        total += best
        exact += best >= 1.6
        if w not in slots[at] and best != 2.4:
            learnt.append((at, w))
    last = len(e) - 1
    if len(m) == 1:
        w = m[0]
        if len(w) == 1 or (len(e) > 1 and last not in borne and not (0 in borne and len(w) >= 3)):
            return 0.0, []
        return (2.2 if last in borne else 2.0), learnt
    if not exact:
        return 0.0, []
    if last not in borne and len(borne) < max(2, len(e) - 1):
        return 0.0, []
    return 2.0 + total - 0.05 * len(free), learnt


def name_score(spelling: str, canonical: str) -> float:
    """How well a spelling fits a canonical name by itself; pronouns and descriptions don't at all."""
    if is_generic(spelling):
        return 0.0
    return profile_score(words_of_name(spelling), tuple((w,) for w in words_of_name(canonical)), canonical)[0]


def slot_keys(slots: Slots, fuzzy: bool) -> set[int]:
    """Hashes under which a name or a profile is compared: its words whole, joined, short forms and initials; ``fuzzy``: also words with one letter left out, two from seven letters on, and how given names begin."""
    words = tuple(v[0] for v in slots)
    joined = "".join(words)
    keys = {joined, *(w for v in slots for w in v if len(w) >= 2)}
    given = slots[0] if slots else ()
    for g in given:
        if len(g) >= 3:
            keys.update(NICKNAMES.get(g, "").split())
    if len(words) >= 3:
        keys.add("#" + "".join(w[0] for w in words))
    if joined and len(joined) <= 8 and (len(words) == 1 or all(len(w) == 1 for w in words)):
        keys.add("#" + joined)
    if fuzzy:
        if len(words) <= 2:
            keys.update(joined[:k] + joined[k + 1 :] for k in range(len(joined)))
        for w in {w for v in slots for w in v}:
            if len(w) >= 4:
                keys.update(w[:k] + w[k + 1 :] for k in range(len(w)))
            if 7 <= len(w) <= 40:
                keys.update(w[:j] + w[j + 1 : k] + w[k + 1 :] for j, k in combinations(range(len(w)), 2))
        for g in given:
            if len(g) >= 3 and (len(words) > 1 or len(g) <= 6):  # short forms that may stand alone
                keys |= {f"~{g[0]}{g[-1]}", f"^{g[:2]}", f"^{g[:3]}"}
    return {zlib.crc32(k.encode()) for k in keys if k}


def block_keys(name: str, fuzzy: bool = True) -> set[int]:
    """slot_keys of a written name."""
    return slot_keys(tuple((w,) for w in words_of_name(name)), fuzzy)


def _matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by sorting both sides, neither of which goes to the driver.

    Spark guesses sizes by files and doesn't see how many rows Python makes of one: blocking keys of
    profiles that it took for less than 256 KB were 55 MB once broadcast, and the threshold may be much higher.
    """
    return left.join(right.hint("merge"), on, how)


def _with_words(names: DataFrame, column: str, fuzzy: bool = False) -> DataFrame:
    """(.., words) of distinct (source_id, column): the telling words with their numbers, as a profile's form; names that tell nobody are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [None if is_generic(n) else " ".join(f"{k}:{w}" for k, w in enumerate(words_of_name(n))) for n in b.column(1).to_pylist()]
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(forms, pa.string())], ["source_id", column, "words"])
            yield out.filter(pa.array([bool(f) for f in forms], pa.bool_()))

    return names.select("source_id", column).distinct().mapInArrow(run, f"source_id string, {column} string, words string")


def _keyed(rows: DataFrame, kept: list[str], fuzzy: bool) -> DataFrame:
    """(kept.., key) rows for blocking of rows (kept.., words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, keys = [], []
            for i, form in enumerate(b.column(len(kept)).to_pylist()):
                ks = slot_keys(_slots(form), fuzzy)
                row += [i] * len(ks)
                keys += ks
            take = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(take) for k in range(len(kept))], pa.array(keys, pa.int64())], [*kept, "key"])

    return rows.select(*kept, "words").mapInArrow(run, f"{', '.join(f'{c} string' for c in kept)}, key bigint")


def _scored(pairs: DataFrame, least: float) -> DataFrame:
    """(source_id, name, entity_id, canonical, score, learnt) of the pairs (source_id, name, words, entity_id, form, canonical) that fit; learnt: new 'slot:word' items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [profile_score(tuple(v[0] for v in _slots(w)), _slots(f), c) for w, f, c in zip(*(b.column(n).to_pylist() for n in ("words", "form", "canonical")))]
            out = pa.RecordBatch.from_arrays(
                [*[b.column(n) for n in ("source_id", "name", "entity_id", "canonical")], pa.array([g[0] for g in got], pa.float64()), pa.array([" ".join(f"{k}:{w}" for k, w in g[1]) for g in got], pa.string())], ["source_id", "name", "entity_id", "canonical", "score", "learnt"]
            )
            yield out.filter(pa.array([g[0] >= least for g in got], pa.bool_()))

    return pairs.mapInArrow(run, "source_id string, name string, entity_id string, canonical string, score double, learnt string")


@F.pandas_udf(DoubleType())
def _alias_score(aliases: pd.Series, canonical: pd.Series) -> pd.Series:
    """Best score of any alias that names more than a family."""
    return pd.Series([max([s for s in (name_score(a, c) for a in (al if al is not None else ()) if a) if s > 2.3] or [0.0]) for al, c in zip(aliases, canonical)], dtype="float64")


def link_names(mentions: DataFrame, entities: DataFrame, params: Linking = Linking()) -> DataFrame:
    """(mention_id, entity_id) of all mentions whose name, as spelled, refers to an entity of the same source_id.

    Null names, ids and sources link nothing; neither do pronouns and descriptions. Repeated
    rows give one pair. Among several entities of one narrative the best fitting has to
    lead clearly; where names leave it open (a family name) the mention's aliases decide, and if they
    don't, it is not linked. Mentions are compared once per distinct spelling.
    """
    p = params
    m = cut(mentions.where("mention_id is not null and name is not null and source_id is not null").select("mention_id", "source_id", "name", F.array_sort(F.array_distinct(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.isNotNull()))).alias("aliases")).distinct())
    e = cut(entities.where("entity_id is not null and canonical_name is not null and source_id is not null").select("source_id", "entity_id", F.col("canonical_name").alias("form")).distinct())
    canonical = cut(_matched(_with_words(e, "form"), e, ["source_id", "form"]).select("source_id", "entity_id", F.col("form").alias("canonical"), "words"))  # an entity has a profile for each of its canonical names
    word = F.split(F.col("item"), ":")
    one = ["source_id", "entity_id", "canonical"]
    items = lambda df, c, rank: df.select(*one, F.explode(F.split(c, " ")).alias("item")).where("item <> ''").select(*one, word[0].cast("int").alias("slot"), F.lit(rank).alias("rank"), word[1].alias("word"))
    known = items(canonical, "words", 0)
    profile = canonical
    open_names = cut(_with_words(m, "name"))
    merged: DataFrame | None = None
    doubtful: DataFrame | None = None  # the ties of all rounds
    fuzzy = False
    while True:  # each round but the first and the last takes names from the open ones
        pairs = _matched(_keyed(open_names, ["source_id", "name"], fuzzy), _keyed(profile, one, fuzzy), ["source_id", "key"]).select(*one, "name").distinct()
        pairs = _matched(_matched(pairs, profile.select(*one, F.col("words").alias("form")), one), open_names, ["source_id", "name"])
        fits = _scored(pairs.select("source_id", "name", "words", "entity_id", "form", "canonical"), p.least)
        held = cut(fits.groupBy("source_id", "name", "entity_id").agg(F.max(F.struct("score", "canonical", "learnt")).alias("_f")).select("source_id", "name", "entity_id", "_f.*"))
        best = Window.partitionBy("source_id", "name")
        lead = held.withColumn("top", F.max("score").over(best)).where(F.col("score") > F.col("top") - p.lead).withColumn("n", F.count("*").over(best))
        sure = cut(lead.where("n = 1").select("source_id", "name", "entity_id", "score", "canonical", "learnt"))
        split = cut(lead.where("n > 1").select("source_id", "name", "entity_id", "score"))
        merged = sure if merged is None else merged.unionByName(sure)
        doubtful = split if doubtful is None else doubtful.unionByName(split)
        some = bool(sure.take(1))
        if fuzzy and not some:
            break
        open_names = cut(_matched(open_names, held.select("source_id", "name").distinct(), ["source_id", "name"], "left_anti"))
        if not open_names.take(1):
            break
        # only spellings that name more than a family enrich a profile; a profile holds each different word once
        new = items(sure.where("score > 2.3"), "learnt", 1).distinct()
        changed = new.select(*one).distinct()
        known = cut(known.unionByName(_matched(new, known.select(*one, "slot", "word"), [*one, "slot", "word"], "left_anti").select(known.columns)))
        words = F.transform(F.array_sort(F.collect_list(F.struct("slot", "rank", "word"))), lambda x: F.concat(x["slot"].cast("string"), F.lit(":"), x["word"]))
        wanted = _matched(known, changed, one, "left_semi") if fuzzy else known  # after the first round every profile meets the open names again, under more keys
        profile = cut(wanted.groupBy(*one).agg(F.array_join(words, " ").alias("words")))
        fuzzy = True
    linked = _matched(m, merged.select("source_id", "name", "entity_id"), ["source_id", "name"]).select("mention_id", "entity_id")
    told = (
        _matched(_matched(m, doubtful, ["source_id", "name"]), e, ["source_id", "entity_id"]).withColumn("told", _alias_score("aliases", "form")).where("told > 0")
        .groupBy("mention_id", "entity_id").agg(F.max("told").alias("told"))
    )
    each = Window.partitionBy("mention_id")
    told = told.withColumn("top", F.max("told").over(each)).where(F.col("told") > F.col("top") - p.lead).withColumn("n", F.count("*").over(each)).where("n = 1").select("mention_id", "entity_id")
    return linked.unionByName(told).distinct()


def variant_mentions(mentions: DataFrame, entities: DataFrame, params: Linking = Linking()) -> DataFrame:
    """The links of mentions whose name is not character for character the entity's canonical name."""
    links = link_names(mentions, entities, params)
    named = _matched(_matched(links, mentions.select("mention_id", "name").distinct(), ["mention_id"]), entities.select("entity_id", "canonical_name").distinct(), ["entity_id"])
    return named.where("name <> canonical_name").select("mention_id", "entity_id").distinct()
