"""Matching entities across sources without a key: label-model linkage.

Candidates come from equality keys in three stages: two records alone with their
reference, party and amount; then equal references; then weaker keys for all records but
those that a stage before settled beyond doubt.  On each candidate a set of matching
functions votes (reference, amount and its rarity, party, date), each with one of a few
verdicts.  A generative model with a hidden "same payment" bit is fitted to the
counts of the verdict patterns by expectation maximisation; it learns how often
each function gives each verdict on true and on false candidates, joins functions
that it finds correlated into one, and gives each pattern its posterior.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.nearest import UNKNOWN_PARTIES
from tallyloom.session import broadcast_if, cut, scratch

#: A ledger row is dated from this many days before its bank row ...
DAYS_BEFORE = 5
#: ... to this many after.
DAYS_AFTER = 2
SLOT_DAYS = DAYS_BEFORE + DAYS_AFTER
LEAST_CONFIDENCE = 0.5
#: Spellings of parties go to the records by a broadcast up to so many, else by a shuffle.
BROADCAST_NAMES = 400_000
#: ... and so are repeats.
BROADCAST_REPEATS = 400_000


# ---------------------------------------------------------------- label model


class LabelModel:
    """Two-class mixture over categorical votes, fitted on pattern counts."""

    def __init__(self, limits: dict[tuple[int, int], float] | None = None, iterations: int = 100, dependence: float = 0.05, smooth: float = 0.5) -> None:
        """``limits``: (function, verdict) -> the most often that a true pair may get
        this verdict; without it the mixture may take agreement of one function for
        the hidden bit."""
        self.limits = limits or {}
        self.iterations, self.dependence, self.smooth = iterations, dependence, smooth

    def _maximise(self, votes: np.ndarray, counts: np.ndarray, q: np.ndarray) -> tuple[float, list[np.ndarray]]:
        weights = np.stack([counts * (1 - q), counts * q])
        tables = []
        for column in votes.T:
            table = np.full((2, column.max() + 1), self.smooth)
            for y in (0, 1):
                np.add.at(table[y], column, weights[y])
            tables.append(table / table.sum(axis=1, keepdims=True))
        for k, rare in enumerate(self.rare):
            excess = np.maximum(tables[k][1] - rare, 0)
            tables[k][1] -= excess
            free = rare >= 1
            tables[k][1][free] += excess.sum() * tables[k][1][free] / max(tables[k][1][free].sum(), 1e-9)
        prior = float(np.clip(weights[1].sum() / counts.sum(), 1e-6, 1 - 1e-6))
        return prior, tables

    def _posterior(self, votes: np.ndarray, prior: float, tables: list[np.ndarray]) -> np.ndarray:
        odds = np.full(len(votes), np.log(prior) - np.log1p(-prior))
        for column, table in zip(votes.T, tables, strict=True):
            odds += np.log(table[1, column]) - np.log(table[0, column])
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def _run(self, votes: np.ndarray, counts: np.ndarray, q: np.ndarray) -> np.ndarray:
        for _ in range(self.iterations):
            prior, tables = self._maximise(votes, counts, q)
            after = self._posterior(votes, prior, tables)
            if np.abs(after - q).max() < 1e-6:
                return after
            q = after
        return q

    def _most_dependent(self, votes: np.ndarray, counts: np.ndarray, q: np.ndarray) -> tuple[float, int, int]:
        """The pair of functions with most mutual information given the class."""
        best = (0.0, 0, 0)
        for i in range(votes.shape[1]):
            for j in range(i + 1, votes.shape[1]):
                total = 0.0
                for w in (counts * q, counts * (1 - q)):
                    joint = np.zeros((votes[:, i].max() + 1, votes[:, j].max() + 1))
                    np.add.at(joint, (votes[:, i], votes[:, j]), w)
                    joint /= max(counts.sum(), 1)
                    mass = joint.sum()
                    free = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True) / max(mass, 1e-12)
                    seen = joint > 0
                    total += float((joint[seen] * np.log(joint[seen] / free[seen])).sum())
                best = max(best, (total, i, j))
        return best

    def fit(self, votes: np.ndarray, counts: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Posterior of each pattern; ``start`` is a first guess.  Functions that are correlated
        become one function of both verdicts, pair by pair while two are left to compare."""
        self.rare = [np.array([self.limits.get((k, v), 1.0) for v in range(votes[:, k].max() + 1)]) for k in range(votes.shape[1])]
        # Dependence is asked under the first guess: two copies of one vote would take
        # over the hidden bit, and given that bit they no longer seem to depend.
        while votes.shape[1] > 2:
            dependence, i, j = self._most_dependent(votes, counts, start)
            if dependence < self.dependence:
                break
            pairs, both = np.unique(votes[:, [i, j]], axis=0, return_inverse=True)
            both = both.reshape(-1)
            # A joint verdict is as rare as the rarer of its parts.
            joint = np.minimum(self.rare[i][pairs[:, 0]], self.rare[j][pairs[:, 1]])
            self.rare = [r for k, r in enumerate(self.rare) if k not in (i, j)] + [joint]
            votes = np.column_stack([np.delete(votes, [i, j], axis=1), both])
        return self._run(votes, counts, start)


# ------------------------------------------------------------------- features


def reference_digits(text: Column) -> Column:
    """The first run of four or more digits of a text, separators inside allowed, as
    digits only; '' if there is none, null for null."""
    return F.translate(F.regexp_extract(text, r"[0-9](?:[ ./-]{0,3}[0-9]){3,}", 0), " ./-", "")


def bare_number(digits: Column) -> Column:
    """Digits as series write them without padding: zeros after a leading year and at the
    start fall away.  Null below three digits."""
    year = digits.startswith("19") | digits.startswith("20")
    bare = F.when((F.length(digits) >= 7) & year, F.concat(F.substring(digits, 1, 4), F.ltrim(F.substring(digits, F.lit(5), F.length(digits)), F.lit("0")))).otherwise(F.ltrim(digits, F.lit("0")))
    return F.when(F.length(digits) >= 3, bare)


# Letters with marks and what they are compared as.
MARKED, PLAIN = "áàâäãåéèêëíìîïóòôöõøúùûüçñ", "aaaaaaeeeeiiiioooooouuuucn"


def _records(rows: DataFrame, digits: list[Column], words: Column, parties: DataFrame) -> DataFrame:
    """(id, day, ccy, am, amk, party, ref1, raw1, ref2, raw2, words); ``parties`` has name,
    party and stem.  Texts are reduced before
    the party is joined, so that no text moves.  ``am`` is the amount for distances,
    ``amk`` a hash of its exact value."""
    known = F.when(~F.col("counterparty").isin(*UNKNOWN_PARTIES), F.col("counterparty"))
    narrow = rows.where("row_id is not null").select(
        F.col("row_id").cast("long").alias("id"),
        F.unix_date("date").alias("day"),
        F.upper(F.trim("currency")).alias("ccy"),
        F.col("amount").cast("double").alias("am"),
        F.when(F.col("amount").isNotNull(), F.xxhash64(F.col("amount").cast("decimal(24,8)"))).alias("amk"),
        known.alias("_name"),
        *[d.alias(f"raw{k}") for k, d in enumerate(digits, 1)],
        words.alias("words"),
    )
    narrow = narrow.join(parties.select(F.col("name").alias("_name"), "party", "stem"), "_name", "left").withColumn("words", F.coalesce("words", F.when(F.length("stem") >= 6, F.col("stem"))))
    return narrow.select("id", "day", "ccy", "am", "amk", "party", *[c for k in (1, 2) for c in (bare_number(F.col(f"raw{k}")).alias(f"ref{k}"), f"raw{k}")], "words")


def bank_records(rows: DataFrame, parties: DataFrame) -> DataFrame:
    """source_a-like rows as records; the reference may stand in the description only."""
    # The description is searched only where the reference says nothing.
    rows = rows.withColumn("_own", reference_digits(F.col("reference")))
    found = F.when(F.length("_own") > 0, F.col("_own")).otherwise(reference_digits(F.col("description")))
    unknown = F.col("counterparty").isNull() | F.col("counterparty").isin(*UNKNOWN_PARTIES)
    return _records(rows, [found, F.lit(None).cast("string")], F.when(unknown, F.translate(F.lower("description"), MARKED, PLAIN)), parties)


def ledger_records(rows: DataFrame, parties: DataFrame) -> DataFrame:
    """source_b-like rows as records; vouchers are no references."""
    voucher = F.upper(F.substring("reference", 1, 3)) == "VCH"
    own = F.when(F.col("invoice").isNotNull(), reference_digits(F.col("invoice"))).when(~voucher, reference_digits(F.col("reference")))
    other = F.when(F.col("invoice").isNotNull() & F.col("reference").isNotNull() & ~voucher & (F.col("reference") != F.col("invoice")), reference_digits(F.col("reference")))
    return _records(rows, [own, other], F.lit(None).cast("string"), parties)


def _meet(bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """(a, b) that share a hashed key; both sides as (h, id)."""
    left, right = bank.select("h", F.col("id").alias("a")), ledger.select("h", F.col("id").alias("b"))
    # Placed by a, pairs are made distinct and meet their bank records without moving again.
    return left.join(right, "h").select("a", "b").repartition("a").distinct()


def _hashed(kind: str, *parts: Column | str) -> Column:
    """The key as a hash; null if a part is unknown."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    whole = columns[0].isNotNull()
    for c in columns[1:]:
        whole = whole & c.isNotNull()
    return F.when(whole, F.xxhash64(F.lit(kind), *columns))


def _listed(records: DataFrame, *arrays: Column) -> DataFrame:
    """(h, id) of all keys; lambdas over arrays are not compiled, so nulls fall away after."""
    none = F.array().cast("array<bigint>")
    return records.select(F.explode(F.array_distinct(F.concat(*[F.coalesce(x, none) for x in arrays]))).alias("h"), "id").where("h is not null")


def _reference_keys(records: DataFrame) -> DataFrame:
    """Equal reference, with the party or with the amount."""
    keys = {f"{r}_{kind}": _hashed(kind, r, "ccy", other) for r in ("ref1", "ref2") for kind, other in (("party", "party"), ("amount", "amk"))}
    return records.select("id", *[c.alias(n) for n, c in keys.items()]).unpivot("id", list(keys), "kind", "h").where("h is not null").select("h", "id")


def _weak_keys(records: DataFrame, bank: bool) -> DataFrame:
    """Keys for records that equal references left alone.

    A reference less one digit (or cut at an end) with the party; the reference, or
    the amount, in a time slot, if one side names no party; amount or amount band with
    the party, in a time slot, if one side has no reference.  Of the last kinds one
    side asks and the other answers: rows that say more never meet each other by
    saying less.
    """
    slot = lambda shift: F.floor((F.col("day") + shift) / SLOT_DAYS).cast("long")
    slots = [F.coalesce(slot(shift), F.lit(-1).cast("long")) for shift in ((-DAYS_BEFORE, DAYS_AFTER) if bank else (0,))]
    # Bands overlap: the bank row stands in two more, so that a tenth more or less meets.
    level = F.log(F.greatest(F.abs("am"), F.lit(0.01))) / 0.12
    bands = [F.floor(level + step) for step in ((0, 1, -1) if bank else (0,))]
    sign = F.signum("am").cast("int")

    def variants(raw: str) -> Column:
        n = F.length(raw)
        less_one = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.substring(F.col(raw), F.lit(1), k - 1), F.substring(F.col(raw), k + 1, n)))
        cut_off = F.array() if bank else F.filter(F.array(F.substring(F.col(raw), F.lit(1), n - 2), F.substring(F.col(raw), F.lit(1), n - 3), F.substring(F.col(raw), F.lit(3), n)), lambda x: F.length(x) >= 4)
        return F.when(F.col(raw).isNotNull() & (n >= 4), F.concat(F.array(F.col(raw)), less_one, cut_off.cast("array<string>")))

    def by_variant(raw: str) -> Column:
        named = F.when(F.col("party").isNotNull(), variants(raw))
        return F.transform(named, lambda v: F.xxhash64(F.lit("typo"), v, "ccy", "party"))

    has_ref = F.col("ref1").isNotNull()
    nameless = F.array(*[_hashed("nameless", r, "ccy", s) for s in slots for r in ("ref1", "ref2")])
    amounts = lambda word: F.array(*[_hashed(word, "amk", "ccy", s) for s in slots])
    mine, theirs = ("bank-nameless", "ledger-nameless") if bank else ("ledger-nameless", "bank-nameless")
    # An equal amount is in the same band too.
    plain = lambda word: F.array(*[_hashed(word, k, sign, "ccy", "party", s) for s in slots for k in bands])
    asks, answers = ("bank-bare", "ledger-bare") if bank else ("ledger-bare", "bank-bare")
    return _listed(
        records,
        by_variant("raw1"),
        F.array().cast("array<bigint>") if bank else by_variant("raw2"),
        F.when(F.col("party").isNull(), nameless) if bank else nameless,
        F.when(has_ref & F.col("party").isNull(), amounts(mine)),
        F.when(has_ref, amounts(theirs)),
        F.when(~has_ref, plain(asks)),
        F.when(has_ref, plain(answers)),
        F.when(~has_ref, plain("both-bare")),
    )


#: Votes: name -> number of verdicts.
VOTES = {"v_ref": 4, "v_amount": 6, "v_party": 4, "v_date": 7}
#: A first guess of what each verdict is worth, in log odds.
START = {
    "v_ref": (0.0, 3.0, 1.0, -3.0),
    "v_amount": (2.5, 2.0, 1.0, 0.0, -4.0, 1.5),
    "v_party": (0.0, 1.5, 1.5, -3.0),
    "v_date": (0.0, -1.5, 0.3, 0.8, 1.0, 0.3, -2.0),
}
#: How often a true pair may at most be contradicted: (vote, verdict) -> share.
LIMITS = {("v_ref", 3): 0.02, ("v_amount", 4): 0.001, ("v_party", 3): 0.005, ("v_date", 1): 0.01, ("v_date", 6): 0.01}


def _alike(x: Column, y: Column) -> Column:
    """One digit wrong, missing, extra or two swapped, or cut off at an end."""
    lev = F.levenshtein(x, y, 2)
    swapped = (lev == 2) & (F.length(x) == F.length(y)) & (F.sort_array(F.split(x, "")) == F.sort_array(F.split(y, "")))
    cut_off = (F.least(F.length(x), F.length(y)) >= 4) & (x.startswith(y) | y.startswith(x) | x.endswith(y) | y.endswith(x))
    return F.coalesce(cut_off | lev.isin(0, 1) | swapped, F.lit(False))


def _ref_verdict() -> Column:
    """0 one side has none, 1 equal, 2 alike, 3 different."""
    raws = [("a_raw1", "b_raw1"), ("a_raw1", "b_raw2")]
    equal = (F.col("a_ref1") == F.col("b_ref1")) | F.coalesce(F.col("a_ref1") == F.col("b_ref2"), F.lit(False))
    alike = F.lit(False)
    for x, y in raws:
        alike = alike | _alike(F.col(x), F.col(y))
    return F.when(F.col("a_ref1").isNull() | F.col("b_ref1").isNull(), 0).when(equal, 1).when(alike, 2).otherwise(3).cast("int")


def _date_verdict(lag: Column) -> Column:
    return F.when(lag.isNull(), 0).when(lag < -4, 1).when(lag < -2, 2).when(lag < 0, 3).when(lag == 0, 4).when(lag == 1, 5).otherwise(6).cast("int")


#: Verdicts on dates that leave no doubt: none known, or not at an edge of the window.
PLAIN_DATES = (0, 2, 3, 4, 5)


def _compared(pairs: DataFrame, bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """(a, b, lag, v_ref, v_amount, v_party, v_date) of pairs inside the window."""
    side = lambda df, p: df.select(F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "id"])
    met = pairs.join(side(bank, "a"), "a").join(side(ledger, "b"), "b").withColumn("lag", F.col("b_day") - F.col("a_day"))
    lag = F.col("lag")
    x, y = F.col("a_am"), F.col("b_am")
    gap, size = F.abs(x - y), F.greatest(F.abs(x), F.abs(y))
    amount = F.when(F.col("a_amk") == F.col("b_amk"), 0).when(gap <= 0.0501, 1).when(gap <= 0.02 * size, 2).when(gap <= 0.1 * size, 3).otherwise(4)
    named = F.coalesce(F.col("a_words").contains(F.col("b_words")), F.lit(False))
    party = F.when(F.col("a_party") == F.col("b_party"), 1).when(F.col("a_party").isNull() & named, 2).when(F.col("a_party").isNull() | F.col("b_party").isNull(), 0).otherwise(3)
    met = met.where(F.coalesce(lag.between(-DAYS_BEFORE, DAYS_AFTER), F.lit(True)))
    return met.select("a", "b", "lag", _ref_verdict().alias("v_ref"), *[c.cast("int").alias(n) for n, c in (("v_amount", amount), ("v_party", party), ("v_date", _date_verdict(lag)))])


def pattern_number() -> Column:
    """All verdicts of a pair as one number."""
    number = F.lit(0)
    for name, verdicts in VOTES.items():
        number = number * verdicts + F.col(name)
    return number.cast("int")


def sole_pairs(bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """Voted pairs (a, b, lag, v_ref, v_amount, v_party, v_date) of a bank and a ledger record that are
    the only ones with their reference, party, currency and amount, at plain dates.

    Nothing can rate higher than such a pair.  Records are folded per key before they move.
    """
    sides = []
    for records, mine in ((bank, "a"), (ledger, "b")):
        keyed = records.where("ref1 is not null and party is not null and amk is not null and ccy is not null")
        cells = {n: F.col(c) if n[0] == mine else F.lit(None).cast("long") for n, c in (("a", "id"), ("b", "id"), ("a_day", "day"), ("b_day", "day"))}
        sides.append(keyed.select(F.xxhash64("ref1", "ccy", "party").alias("h"), "amk", *[c.cast("long").alias(n) for n, c in cells.items()]))
    met = sides[0].unionByName(sides[1]).groupBy("h", "amk").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), *[F.min(c).alias(c) for c in ("a", "b", "a_day", "b_day")])
    lag = (F.col("b_day") - F.col("a_day")).cast("int")
    alone = met.where((F.col("n_a") == 1) & (F.col("n_b") == 1)).select("a", "b", lag.alias("lag"))
    verdicts = {"v_ref": F.lit(1), "v_amount": F.lit(0), "v_party": F.lit(1), "v_date": _date_verdict(F.col("lag"))}
    return alone.select("a", "b", "lag", *[c.cast("int").alias(n) for n, c in verdicts.items()]).where(F.col("v_date").isin(*PLAIN_DATES))


def left_over(records: DataFrame, pairs: DataFrame, side: str, name: str) -> DataFrame:
    """The records that stand in no pair."""
    return cut(records.join(pairs.select(F.col(side).alias("id")), "id", "left_anti"), name)


def strong_candidates(bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """Voted candidates with an equal reference, with the number of candidates of either record."""
    met = _compared(_meet(_reference_keys(bank), _reference_keys(ledger)), bank, ledger)
    return met.withColumn("n_b", F.count("*").over(Window.partitionBy("b"))).withColumn("n_a", F.count("*").over(Window.partitionBy("a")))


def settling_patterns() -> set[int]:
    """The patterns that settle two records if neither has another equal reference: a
    near amount, no other party and plain dates."""
    sizes = tuple(VOTES.values())
    return {int(np.ravel_multi_index((1, amount, party, date), sizes)) for amount in range(4) for party in range(3) for date in PLAIN_DATES}


def candidates(bank: DataFrame, ledger: DataFrame, strong: DataFrame, settled: DataFrame) -> DataFrame:
    """Voted candidates (a, b, lag, v_ref, pattern, single) of all stages; ``single`` if neither
    record has another candidate.  ``bank`` and ``ledger`` are the records that ``settled``
    leaves, ``strong`` the equal references among them.

    Only two records that are each other's sole equal reference, under a settling pattern,
    are not sought under weaker keys.  Weak keys never bring together two rows
    with quite different references, nor amounts further apart than a tenth: like payments
    of one party stay apart.
    """
    weak = _compared(_meet(_weak_keys(bank, True), _weak_keys(ledger, False)), bank, ledger)
    # Equal references with the same party or amount are in the stage before already.
    both = strong.unionByName(weak.where("v_ref in (0, 2) and v_amount < 4 or v_ref = 1 and v_party <> 1 and v_amount <> 0"))
    # An equal amount says less if several candidates of the bank row have it.
    plain = ((F.col("v_amount") == 0) & (F.col("v_party") != 3)).cast("int")
    of_a, of_b = Window.partitionBy("a"), Window.partitionBy("b")
    counted = both.withColumns({"rivals": F.sum(plain).over(of_a), "n_a": F.count("*").over(of_a)}).withColumn("n_b", F.count("*").over(of_b))
    amount = F.when((F.col("v_amount") == 0) & (F.col("rivals") > 1), F.lit(5)).otherwise(F.col("v_amount")).cast("int")
    single = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    named = counted.select("a", "b", "lag", "v_ref", amount.alias("v_amount"), "v_party", "v_date", single.alias("single"))
    return named.unionByName(settled.withColumn("single", F.lit(True))).select("a", "b", "lag", "v_ref", pattern_number().alias("pattern"), "single")


def fitted_patterns(voted: DataFrame) -> list[tuple[int, float]]:
    """(pattern, posterior) of each pattern of verdicts that occurs.

    The patterns number at most the product of the verdicts (672), whatever the data;
    only their counts come to the driver.
    """
    names = list(VOTES)
    rows = voted.groupBy("pattern").count().collect()
    if not rows:
        return []
    numbers = np.array([r["pattern"] for r in rows])
    votes = np.column_stack(np.unravel_index(numbers, tuple(VOTES.values())))
    counts = np.array([r["count"] for r in rows], dtype=float)
    odds = sum(np.array(START[n])[votes[:, k]] for k, n in enumerate(names)) - 2.0
    q = LabelModel({(names.index(n), v): share for (n, v), share in LIMITS.items()}).fit(votes, counts, 1 / (1 + np.exp(-odds)))
    return list(zip(map(int, numbers), map(float, q), strict=True))


def link_records(bank: DataFrame, ledger: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """(a, b, confidence): pairs of one payment, each record in one pair at most.

    Input as ``bank_records`` and ``ledger_records`` give it; any column but ``id`` may be
    null (a null votes "don't know"); an empty side gives an empty result.  Pairs
    below ``least`` are dropped.  Each round pairs records that are each other's best
    (posterior, then equal reference, nearer date, same place among equally rated rivals,
    smaller ids), and leaves the rest to the next round, until nothing is left.
    """
    with scratch(bank.sparkSession) as keep:
        return keep(linked_records(bank, ledger, least), "linked")


def linked_records(bank: DataFrame, ledger: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """As ``link_records``; the result still reads tables of the ``scratch`` block around."""
    spark = bank.sparkSession
    votes = ["a", "b", "lag", *VOTES]
    sole = cut(sole_pairs(bank, ledger), "sole")
    bank, ledger = left_over(bank, sole, "a", "bank-left"), left_over(ledger, sole, "b", "ledger-left")
    strong = cut(strong_candidates(bank, ledger).withColumn("pattern", pattern_number()), "strong")
    settling = settling_patterns()
    while True:
        sure = (F.col("n_a") == 1) & (F.col("n_b") == 1) & F.col("pattern").isin(sorted(settling))
        settled = strong.where(sure).select(*votes)
        rest = [left_over(records, settled, side, name) for records, side, name in ((bank, "a", "bank-rest"), (ledger, "b", "ledger-rest"))]
        voted = cut(candidates(*rest, strong.where(~sure).select(*votes), settled.unionByName(sole)), "voted")
        fitted = fitted_patterns(voted)
        # A pattern that is not trusted settles nothing: its records are sought on.
        doubted = settling & {pattern for pattern, confidence in fitted if confidence < least}
        if not doubted:
            break
        settling -= doubted
    patterns = spark.createDataFrame(fitted, "pattern int, confidence double")
    rated = voted.join(F.broadcast(patterns), "pattern").where(F.col("confidence") >= least)  # at most 672 patterns
    done = rated.where("single").select("a", "b", "confidence")
    # Only records with a choice go through the rounds.
    level = F.struct("confidence", (F.col("v_ref") == 1).alias("same"), (-F.abs(F.coalesce("lag", F.lit(99)))).alias("near"))
    left = cut(rated.where("not single").select("a", "b", "confidence", level.alias("level")), "rated")
    while not left.isEmpty():
        # The k-th of equally rated rivals asks for the k-th: like payments pair at once.
        at_a = F.row_number().over(Window.partitionBy("b", "level").orderBy("a"))
        at_b = F.row_number().over(Window.partitionBy("a", "level").orderBy("b"))
        rating = F.struct("level", (-F.abs(F.col("at_a") - F.col("at_b"))).alias("apart"), (-F.col("b")).alias("nb"), (-F.col("a")).alias("na"))
        placed = left.withColumn("at_a", at_a).withColumn("at_b", at_b).select("a", "b", "confidence", rating.alias("r"))
        best_a = placed.groupBy("a").agg(F.max_by(F.struct("b", "confidence"), "r").alias("x")).select("a", "x.b", "x.confidence")
        best_b = placed.groupBy("b").agg(F.max_by("a", "r").alias("a"))
        # The best rated pair of all is mutual, so each round pairs some.
        paired = cut(best_a.join(best_b, ["a", "b"]), "paired")
        done = done.unionByName(paired)
        left = cut(left.join(paired.select("a"), "a", "left_anti").join(paired.select("b"), "b", "left_anti"), "rated")
    return done


def with_repeats(pairs: DataFrame, repeats: DataFrame) -> DataFrame:
    """All pairs of rows: each record stands for its repeats (first_row_id, repeat_row_id
    of both tables, whose row ids differ)."""
    repeats = broadcast_if(repeats, BROADCAST_REPEATS)

    def expand(df: DataFrame, key: str, repeats: DataFrame) -> DataFrame:
        again = df.join(repeats.withColumnRenamed("first_row_id", key), key).drop(key).withColumnRenamed("repeat_row_id", key)
        return df.unionByName(again)

    return expand(expand(pairs, "a", repeats), "b", repeats)
