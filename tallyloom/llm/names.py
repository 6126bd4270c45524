"""Variant spellings of names typed by people: noisy-channel attribution.

Every spelling is read into a signature (family or brand name, given name or
trade, initials, legal form).  Complete, frequent signatures are the candidate
canonical forms; each spelling is attached to the candidate with the highest
posterior, prior frequency times the likelihoods of the typos, abbreviations,
short forms, initials and dropped parts that turn the one into the other.  How often
each of these happens is estimated from the corpus, and so are the trades that no list
has: words that go with many brands.  Spellings of the same words in another order,
case or legal form are one party whatever they are read as.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.history import first_of_record
from tallyloom.llm.nearest import UNKNOWN_PARTIES
from tallyloom.session import cut, scratch

# Legal forms by the letters they are written with.
LEGAL_FORMS = {
    "ltd": "ltd", "limited": "ltd",
    "inc": "inc", "incorporated": "inc", "corp": "inc", "corporation": "inc",
    "llc": "llc", "plc": "plc",
    "gmbh": "gmbh", "gesellschaft mbh": "gmbh", "g m b h": "gmbh",
    "gmbh co kg": "kg", "gmbh und co kg": "kg", "kg": "kg", "g m b h co kg": "kg", "gesellschaft mbh co kg": "kg",
    "ag": "ag", "a g": "ag", "aktiengesellschaft": "ag",
    "bv": "bv", "b v": "bv", "nv": "nv", "n v": "nv",
    "sa": "sa", "s a": "sa", "sarl": "sarl", "s a r l": "sarl", "sas": "sas",
    "srl": "srl", "s r l": "srl", "spa": "spa", "s p a": "spa",
    "oy": "oy", "oy ab": "oy", "ab": "ab", "a b": "ab", "as": "as", "aps": "aps",
}
# Words before a name that are no part of it.
PERSON_TITLES = {"mr", "ms", "mrs", "mme", "dr", "prof", "herr", "frau", "fam", "familie", "family", "sr", "sra"}
FIRM_TITLES = {"fa", "firma", "messrs"}
# Qualifiers and trades in names of firms.
QUALIFIERS = ("general", "united", "national", "european", "central", "maritime", "northern", "southern", "eastern", "western", "international", "global", "royal", "first")
TRADES = (
    "associates", "bakeries", "brothers", "construction", "energy", "engineering", "furniture", "laboratories", "logistics", "management", "manufacturing",
    "packaging", "pharmaceuticals", "services", "shipping", "technologies", "textiles", "trading", "consulting", "electronics", "foods", "holdings", "insurance",
    "media", "motors", "partners", "printing", "properties", "software", "solutions", "steel", "systems", "transport",
)
# Abbreviations that letters alone don't explain.
SPOKEN = {"nrg": ("energy",), "bakery": ("bakeries",), "laboratory": ("laboratories",), "xport": ("transport",)}
# Short forms of given names in common use.
SHORT_FORMS = {
    "abigail": "abby gail", "abraham": "abe", "albert": "al bert bertie", "alejandro": "alex jandro", "alexander": "alex sasha sandy xander", "alexandra": "alex sandra lexi", "alfred": "alf fred alfie",
    "andreas": "andi", "andrew": "andy drew", "anthony": "tony ant", "antonio": "toni tonio", "antoinette": "toni nettie", "arthur": "artie", "barbara": "barb barbie", "beatrice": "bea trixie",
    "benjamin": "ben benny benji", "bernard": "bernie", "caroline": "carrie caro", "catherine": "cathy kate cat", "charles": "charlie chuck", "charlotte": "lotte charlie", "christian": "chris", "christina": "chris tina chrissy",
    "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "dominic": "dom nick", "donald": "don donnie", "dorothea": "dora thea dorle", "dorothy": "dottie dolly", "edmund": "ed ned",
    "edward": "ed ned ted eddie", "eleanor": "nell nora ellie", "elizabeth": "liz beth betty lizzie eliza", "emanuel": "manny", "eugene": "gene", "florence": "flo", "francesco": "franco cecco", "francis": "frank", "francisco": "paco pancho curro",
    "franziska": "franzi sissi", "frederick": "fred fritz freddy", "friedrich": "fritz fiete", "gabriel": "gabe", "geoffrey": "geoff", "gerald": "gerry", "gerhard": "gerd", "gertrude": "trude gerti", "giovanni": "gianni nino", "giuseppe": "beppe peppe pino",
    "gregory": "greg", "guillermo": "memo guille", "harold": "harry hal", "heinrich": "heinz heiner", "henrietta": "etta hettie henni", "henry": "harry hank", "isabella": "bella izzy", "jacob": "jake", "james": "jim jimmy jamie", "janet": "jan",
    "jennifer": "jen jenny", "jeremiah": "jerry", "jessica": "jess jessie", "johannes": "hannes jo hans", "john": "jack johnny", "jonathan": "jon", "josefina": "pepa jo fina josie", "joseph": "joe joey", "josef": "sepp", "joshua": "josh",
    "judith": "judy", "julia": "jule", "katharina": "kathi kati trina", "katherine": "kate kathy kit katie", "kenneth": "ken kenny", "lawrence": "larry", "leonard": "len lenny leo", "leopold": "leo poldi", "lorenzo": "renzo", "louise": "lou lulu",
    "madeleine": "maddie", "magdalena": "lena magda leni", "manuel": "manolo manu", "marcus": "marc", "margaret": "maggie peggy meg greta", "margarethe": "grete gretel", "martin": "marty", "mary": "molly polly", "matthew": "matt", "matthias": "matze hias",
    "maximilian": "max", "michael": "mike mick micky", "michelle": "shelly", "nathaniel": "nat nate", "nicholas": "nick klaus nico", "nicole": "nicky", "ottilie": "tilly otti", "pamela": "pam", "patricia": "pat trish patty", "patrick": "pat paddy",
    "peter": "pete", "philip": "phil pip", "rafael": "rafa", "raymond": "ray", "rebecca": "becky", "richard": "rick dick rich", "robert": "bob rob bobby", "ronald": "ron ronnie", "rosalind": "ros", "rudolf": "rudi", "samuel": "sam sammy",
    "sebastian": "seb basti", "sigmund": "sigi", "stephen": "steve", "steven": "steve", "susan": "sue susie", "susanna": "sue sanna susi", "teresa": "tess terry resi", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim", "ulrich": "uli",
    "ulrike": "uli rike ulla", "valentina": "vale tina", "veronica": "vroni ronnie", "victoria": "vicky", "vincent": "vince", "virginia": "ginny", "walter": "walt wally", "wilhelm": "willi", "wilhelmina": "mina minnie", "william": "bill will liam willy",
    "yolanda": "yoli yola", "zacharias": "zach zack",
}
GIVEN = tuple(SHORT_FORMS)
FULL_OF: dict[str, tuple[str, ...]] = {}
for _full, _shorts in SHORT_FORMS.items():
    for _s in _shorts.split():
        FULL_OF[_s] = (*FULL_OF.get(_s, ()), _full)

#: A first guess of how often typing does each of these to a name; the corpus corrects it.
RATES = {
    "typo": 0.01, "split": 0.02, "short": 0.1, "initial": 0.08, "abbreviated": 0.1, "spelt short": 0.02, "no middle": 0.3, "new middle": 0.01,
    "no legal": 0.1, "other legal": 0.005, "no trade": 0.02, "no qualifier": 0.001, "letters only": 0.05,
}
#: An estimate stays within this factor of the guess, so that rare changes stay rarer than common ones.
TRUST = 5.0
#: Brands that a word must go with, beside a legal form, to count as a trade: so many, and this
#: share of all pairs of words, which bounds the trades found to 500.
LEAST_BRANDS, BRAND_SHARE = 8, 0.002
#: A spelling whose best candidate explains it less than this stands for itself.
LEAST = math.log(1e-7)


def fold(text: str) -> str:
    """Lower case without marks on letters."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


@lru_cache(maxsize=200_000)
def one_edit(a: str, b: str) -> bool:
    """Equal but for one inserted, missing, wrong or swapped letter."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def _subsequence(short: str, word: str) -> bool:
    letters = iter(word)
    return all(c in letters for c in short)


def weigh(changes: tuple[str, ...], rates: dict[str, float] = RATES) -> float:
    """log P of the changes, as independent."""
    return sum(math.log(rates[c]) for c in changes)


@lru_cache(maxsize=200_000)
def word_readings(token: str, words: tuple[str, ...], by_head: bool = False) -> dict[str, tuple[str, ...]]:
    """The vocabulary words a token may stand for, with the changes that explain it."""
    if token in words:
        return {token: ()}
    out: dict[str, tuple[str, ...]] = {w: ("abbreviated",) for w in SPOKEN.get(token, ()) if w in words}
    for w in words:
        if w in out:
            continue
        if len(token) >= 4 and one_edit(token, w):
            out[w] = ("typo",)
        elif 2 <= len(token) < len(w) and w.startswith(token):
            out[w] = ("abbreviated",)
        elif 3 <= len(token) < len(w) and token[0] == w[0] and _subsequence(token, w):
            out[w] = ("spelt short",)
    if not out and by_head and len(token) >= 5:  # an abbreviation with a typo, told by its head
        for w in words:
            if w.startswith(token[:4]) and len(token) < len(w):
                out[w] = ("abbreviated", "typo")
    return out


@lru_cache(maxsize=200_000)
def given_readings(token: str) -> dict[str, tuple[str, ...]]:
    """The given names a token may stand for, with the changes that explain it."""
    if token in GIVEN:
        return {token: ()}
    out: dict[str, tuple[str, ...]] = {full: ("short",) for full in FULL_OF.get(token, ())}
    if not out and len(token) >= 4:
        out = {w: ("typo",) for w in GIVEN if one_edit(token, w)}
        for short, fulls in FULL_OF.items():
            if len(short) >= 4 and one_edit(token, short):
                out.update({w: ("short", "typo") for w in fulls if w not in out})
    return out


def _likely(readings: dict[str, tuple[str, ...]]) -> float:
    return max(map(weigh, readings.values()), default=-math.inf)


def _legal_tail(tokens: list[str]) -> tuple[list[str], str]:
    """Tokens without the legal form at their end, and the form."""
    for k in range(max(1, len(tokens) - 6), len(tokens)):
        if (form := LEGAL_FORMS.get(" ".join(tokens[k:]))) is not None:
            return tokens[:k], form
    return tokens, ""


def signature(name: str, trades: tuple[str, ...] = TRADES) -> dict[str, str | bool] | None:
    """What a spelling says: kind P or F, stem, given or trade, initials, legal form."""
    text = fold(name).replace("'", "").replace("’", "")
    before_comma = re.findall(r"[^\W_]+", text.split(",")[0]) if "," in text else []
    tokens = re.findall(r"[^\W_]+", text)
    title = ""
    while len(tokens) > 1 and tokens[0] in PERSON_TITLES | FIRM_TITLES:
        title = "F" if tokens[0] in FIRM_TITLES else title or "P"
        tokens = tokens[1:]
        before_comma = before_comma[1:]
    if not tokens:
        return None
    body, legal = _legal_tail(tokens)
    if title == "P":
        body, legal = tokens, ""
    roles = []
    for t in body:
        if t in QUALIFIERS:
            roles.append("q")
        elif t in trades:
            roles.append("t")
        else:
            roles.append("?")
    # A lone word names no person: it is a firm without trade and form.
    firm = title == "F" or (title != "P" and (bool(legal) or "t" in roles or "q" in roles or len(tokens) == 1))
    if not firm and title != "P" and not any(len(t) == 1 or given_readings(t) for t in body):
        firm = any(word_readings(t, trades, True) for t in body[1:])
    return _firm(body, roles, legal, trades) if firm else _person(tokens if not legal else body, before_comma)


def _firm(body: list[str], roles: list[str], legal: str, trades: tuple[str, ...]) -> dict[str, str | bool]:
    stem, qualifier, trade, letters = [], "", "", ""
    have_trade = "t" in roles
    for t, role in zip(body, roles, strict=True):
        if role == "q" and not qualifier:
            qualifier = t
        elif role == "t" and not trade:
            trade = t
        elif len(t) >= 9 and _likely(word_readings(t, trades + QUALIFIERS)) < weigh(("typo",)):
            stem.append(t)
        elif len(t) == 2 and not have_trade and t not in ("un", "co") and not letters and any(t[1] == w[0] for w in trades) and any(t[0] == w[0] for w in QUALIFIERS):
            letters = t
        elif len(t) > 1 and not qualifier and word_readings(t, QUALIFIERS) and (have_trade or trade or _likely(word_readings(t, trades, True)) <= _likely(word_readings(t, QUALIFIERS))):
            qualifier = t
        elif len(t) > 1 and not have_trade and not trade and word_readings(t, trades, True):
            trade = t
        else:
            stem.append(t)
    clean = bool(trade in trades and (not qualifier or qualifier in QUALIFIERS) and not letters and len(stem) == 1 and legal)
    return {"kind": "F", "stem": "".join(stem), "word": trade, "extra": qualifier, "letters": letters, "legal": legal, "clean": clean, "split": len(stem) > 1}


def _person(tokens: list[str], before_comma: list[str]) -> dict[str, str | bool]:
    initials = "".join(t for t in tokens if len(t) == 1)
    words = [t for t in tokens if len(t) > 1]
    family = [t for t in before_comma if len(t) > 1]
    if family and len(family) < len(words):
        given = [t for t in words if t not in family]
    elif len(words) >= 2:
        known = [t for t in words if given_readings(t)]
        exact = [t for t in known if _likely(given_readings(t)) >= weigh(("short",))] or known
        given = [exact[0]] if exact else ([words[0]] if not initials or tokens[0] == words[0] else [])
        family = list(words)
        for t in given:
            family.remove(t)
    else:
        given, family = [], words
    word = given[0] if given else ""
    letters = "" if word else initials[:1]
    middle = initials if word else initials[1:]
    return {"kind": "P", "stem": "".join(family), "word": word, "extra": middle[:1], "letters": letters, "legal": "", "clean": bool(word) and (word in GIVEN or not given_readings(word)) and len(family) == 1, "split": len(family) > 1}


def first_letters(sig: dict, trades: tuple[str, ...] = TRADES) -> list[str]:
    """Letters that the given name or trade may begin with; '*' if it says nothing."""
    if sig["kind"] == "P":
        if sig["word"]:
            return sorted({w[0] for w in given_readings(sig["word"])} or {sig["word"][0]})
        return [sig["letters"]] if sig["letters"] else ["*"]
    if sig["word"]:
        return sorted({w[0] for w in word_readings(sig["word"], trades, True)} or {sig["word"][0]})
    return [sig["letters"][1]] if sig["letters"] else ["*"]


def stem_keys(stem: str) -> list[str]:
    """The stem and the stem less each one letter; stems one edit apart share a key."""
    return list(dict.fromkeys([stem, *(stem[:k] + stem[k + 1 :] for k in range(len(stem)))])) if len(stem) >= 5 else [stem]


def changes(v: dict, c: dict, trades: tuple[str, ...] = TRADES) -> tuple[str, ...] | None:
    """What typing did to a party spelt c if it came out as v; None if v can't mean c."""
    if v["kind"] != c["kind"]:
        return None
    done: list[str] = ["split"] if v["split"] else []
    if v["stem"] != c["stem"]:
        if len(v["stem"]) < 5 or not one_edit(v["stem"], c["stem"]):
            return None
        done.append("typo")
    if v["kind"] == "P":
        more = _person_changes(v, c)
    else:
        more = _firm_changes(v, c, trades)
    return None if more is None else (*done, *more)


def _shared_reading(mine: dict, theirs: dict) -> tuple[str, ...] | None:
    """The likeliest changes under which two words stand for one."""
    return max(((*mine[w], *theirs[w]) for w in mine if w in theirs), key=weigh, default=None)


def _begins(short: str, full: str) -> bool:
    """Whether a given name is cut to its beginning, as Ben for Benjamin: by more than a third."""
    return 3 <= len(short) and full.startswith(short) and 3 * len(short) <= 2 * len(full)


def _person_changes(v: dict, c: dict) -> tuple[str, ...] | None:
    done: tuple[str, ...] = ()
    if v["word"]:
        mine, theirs = given_readings(v["word"]), given_readings(c["word"])
        if v["word"] == c["word"]:
            pass
        elif mine and theirs:
            both = _shared_reading(mine, theirs)
            if both is None:
                return None
            done += both
        elif c["word"] and len(v["word"]) >= 4 and one_edit(v["word"], c["word"]):
            done += ("typo",)
        elif c["word"] and (_begins(v["word"], c["word"]) or _begins(c["word"], v["word"])):
            done += ("short",)
        else:
            return None
    elif v["letters"]:
        heads = {g[0] for g in given_readings(c["word"])} or {c["word"][:1]} if c["word"] else {c["letters"]}
        if v["letters"] not in heads:
            return None
        done += ("initial",)
    else:
        return None
    if v["extra"] != c["extra"]:
        if v["extra"] and c["extra"]:
            return None
        done += ("new middle",) if v["extra"] else ("no middle",)
    return done


def _firm_changes(v: dict, c: dict, trades: tuple[str, ...]) -> tuple[str, ...] | None:
    done: tuple[str, ...] = ()
    if v["letters"]:
        q, t = c["extra"], c["word"]
        if not (q and t and v["letters"] == q[0] + t[0]):
            return None
        done += ("letters only",)
    elif not v["word"] and not v["extra"]:
        if c["word"]:
            if v["legal"] and c["legal"] and v["legal"] != c["legal"]:
                return None
            done += ("no trade",)
    else:
        for key, vocabulary, dropped in (("word", trades, "no trade"), ("extra", QUALIFIERS, "no qualifier")):
            if v[key] == c[key]:
                continue
            if not v[key]:
                done += (dropped,)
                continue
            if not c[key]:
                return None
            both = _shared_reading(word_readings(v[key], vocabulary, key == "word"), word_readings(c[key], vocabulary, key == "word"))
            if both is None:
                return None
            done += both
    if v["legal"] != c["legal"]:
        done += ("other legal",) if v["legal"] and c["legal"] else ("no legal",)
    return done


def likelihood(v: dict, c: dict, rates: dict[str, float] = RATES, trades: tuple[str, ...] = TRADES) -> float:
    """log P(spelling v | party spelt c); -inf if v can't mean c."""
    done = changes(v, c, trades)
    return -math.inf if done is None else weigh(done, rates)


def bag(name: str) -> str:
    """The words of a spelling in order of letters, without titles, legal form, case and marks;
    empty for less than two words."""
    tokens = re.findall(r"[^\W_]+", fold(name).replace("'", "").replace("’", ""))
    while len(tokens) > 1 and tokens[0] in PERSON_TITLES | FIRM_TITLES:
        tokens = tokens[1:]
    tokens, _ = _legal_tail(tokens)
    return " ".join(sorted(tokens)) if sum(len(t) > 1 for t in tokens) > 1 else ""


FIELDS = ("kind", "stem", "word", "extra", "letters", "legal", "clean", "split")
SIG_DDL = "kind string, stem string, word string, extra string, letters string, legal string, clean boolean, split boolean"


def _reader(trades: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, n in zip(pdf["name"], pdf["n"], strict=True):
                sig = signature(name, trades) or {"kind": "X", "stem": fold(name), "word": "", "extra": "", "letters": "", "legal": "", "clean": False, "split": False}
                rows.append((name, n, bag(name), *(sig[f] for f in FIELDS)))
            yield pd.DataFrame(rows, columns=["name", "n", "bag", *FIELDS])

    return run


def _keyed(canonical_side: bool, trades: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sig in pdf.to_dict("records"):
                heads = first_letters(sig, trades)
                if canonical_side:
                    heads = [*dict.fromkeys([*heads, "*"])]
                for stem in stem_keys(sig["stem"]):
                    rows.extend((sig["sig"], f"{sig['kind']}{h}{stem}") for h in heads)
            yield pd.DataFrame(rows, columns=["sig", "key"])

    return run


def _scorer(rates: dict[str, float], trades: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            sides = [pdf[[f"{side}_{f}" for f in FIELDS]].itertuples(index=False, name=None) for side in "vc"]
            for v_sig, c_sig, v_n, c_n, v, c in zip(pdf["v_sig"], pdf["c_sig"], pdf["v_n"], pdf["c_n"], *sides, strict=True):
                done = changes(dict(zip(FIELDS, v, strict=True)), dict(zip(FIELDS, c, strict=True)), trades)
                # What can be meant is settled under the guess; the estimate only ranks.
                if done is not None and weigh(done) >= LEAST:
                    fit = weigh(done, rates)
                    out.append((v_sig, c_sig, v_n, fit, fit + math.log(c_n), list(done)))
            yield pd.DataFrame(out, columns=["sig", "parent", "n", "fit", "posterior", "changes"]).astype({"sig": "int64", "parent": "int64", "n": "int64", "fit": float, "posterior": float})

    return run


def _candidates(variants: DataFrame, canonical: DataFrame, trades: tuple[str, ...]) -> DataFrame:
    """Pairs (v_*, c_*) of signatures that share a key.

    A complete form may only follow one that is more frequent (ties: more complete,
    then smaller id), so the pointers have no cycles.
    """
    kv = variants.select("sig", *FIELDS).mapInPandas(_keyed(False, trades), "sig long, key string")
    kc = canonical.select("sig", *FIELDS).mapInPandas(_keyed(True, trades), "sig long, key string")
    pairs = kv.join(kc.withColumnRenamed("sig", "c_sig"), "key").where("sig <> c_sig").select(F.col("sig").alias("v_sig"), "c_sig").distinct()
    v = variants.select(*[F.col(c).alias(f"v_{c}") for c in ("sig", "n", "rank", *FIELDS)])
    c = canonical.select(*[F.col(c).alias(f"c_{c}") for c in ("sig", "n", "rank", *FIELDS)])
    return pairs.join(v, "v_sig").join(c, "c_sig").where("c_rank > v_rank").drop("v_rank", "c_rank")


def _attached(both: DataFrame, rates: dict[str, float], trades: tuple[str, ...]) -> DataFrame:
    """(sig, n, parent, changes): for each variant its most probable canonical form."""
    scored = both.mapInPandas(_scorer(rates, trades), "sig long, parent long, n long, fit double, posterior double, changes array<string>")
    best = scored.groupBy("sig", "n").agg(F.max_by(F.struct("parent", "changes"), F.struct("posterior", "fit", F.col("parent"))).alias("x"))
    return best.select("sig", "n", "x.parent", "x.changes")


def estimated_rates(attached: DataFrame, spellings: int) -> dict[str, float]:
    """How often each change happens, per spelling written, from the changes of a first
    attachment; the guess counts as a hundred spellings."""
    seen = {r["change"]: r["n"] for r in attached.select("n", F.explode("changes").alias("change")).groupBy("change").agg(F.sum("n").alias("n")).collect()}
    rates = {name: (seen.get(name, 0) + 100 * guess) / (spellings + 100) for name, guess in RATES.items()}
    return {name: min(max(rate, RATES[name] / TRUST), min(RATES[name] * TRUST, 0.5)) for name, rate in rates.items()}


def _pairs_of_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for name in pdf["name"]:
            tokens = re.findall(r"[^\W\d_]+", fold(name).replace("'", ""))
            body, legal = _legal_tail(tokens)
            words = [t for t in body if len(t) >= 4] if legal else []
            rows.extend((x, y) for x in words for y in words if x != y)
        yield pd.DataFrame(rows, columns=["word", "other"])


def learned_trades(counted: DataFrame) -> tuple[str, ...]:
    """The trades of the lists, and the words that go with so many rarer words beside a legal
    form as only trades do; most frequent first, without those that a word before them
    explains (abbreviations, typos)."""
    pairs = cut(counted.mapInPandas(_pairs_of_words, "word string, other string").distinct(), "words")
    degrees = pairs.groupBy("word").agg(F.count("*").alias("d"))
    rarer = pairs.join(degrees, "word").join(degrees.select(F.col("word").alias("other"), F.col("d").alias("od")), "other").where("od * 4 <= d")
    least = max(LEAST_BRANDS, BRAND_SHARE * pairs.count())
    found = rarer.groupBy("word").agg(F.count("*").alias("brands")).where(F.col("brands") >= least).orderBy(F.col("brands").desc(), "word").collect()
    trades = TRADES
    for row in found:  # at most 1 / BRAND_SHARE
        if not word_readings(row["word"], trades + QUALIFIERS, True):
            trades = (*trades, row["word"])
    return trades


def link_names(names: DataFrame, learn: bool = True) -> DataFrame:
    """(name, n, party, stem): every spelling with its party and its folded main name.

    ``names`` has one column ``name`` with repeats; nulls and the unknown marks name
    nobody and are left out, as is nothing else: a blank or odd spelling is its own
    party.  ``party`` is the id of the party's leading form; spellings of one party
    share it.  An empty table gives an empty result.  Without ``learn`` the trades are
    those of the lists and the rates the first guess.

    Names are counted before anything else, so a name on a third of all rows is
    one row afterwards.  Candidates share a stem (or a stem less one letter) and the
    initial of given name or trade with the variant; their number is bounded by
    given names and middle initials, or trades and qualifiers, never by the data.
    """
    with scratch(names.sparkSession) as keep:
        return keep(_linked_names(names, learn), "named")


def _linked_names(names: DataFrame, learn: bool) -> DataFrame:
    known = names.where(F.col("name").isNotNull() & ~F.col("name").isin(*UNKNOWN_PARTIES))
    counted = known.groupBy("name").agg(F.count("*").alias("n"))
    trades = TRADES
    if learn:
        counted = cut(counted, "counted")
        trades = learned_trades(counted)
    spelt = cut(counted.mapInPandas(_reader(trades), f"name string, n long, bag string, {SIG_DDL}"), "spelt")
    spelt = spelt.withColumn("sig", F.xxhash64(*FIELDS))
    sigs = spelt.groupBy("sig", *FIELDS).agg(F.sum("n").alias("n"))
    fullness = F.when(F.col("clean"), F.lit(2)).otherwise(F.lit(0)) + F.when((F.col("kind") == "P") & (F.col("extra") != ""), F.lit(1)).otherwise(F.lit(0))
    sigs = cut(sigs.withColumn("rank", F.struct(fullness.alias("full"), F.col("n").alias("n"), F.col("sig").alias("sig"))), "signatures")

    both, rates = _candidates(sigs, sigs.where("clean"), trades), RATES
    if learn:
        both = cut(both, "candidates")
        rates = estimated_rates(_attached(both, RATES, trades), sigs.agg(F.sum("n")).first()[0] or 0)
    first = cut(_attached(both, rates, trades).select("sig", "parent"), "attached")
    # Spellings without a complete candidate may still belong together.
    alone = sigs.join(first, "sig", "left_anti").where("not clean")
    second = _attached(_candidates(alone, alone, trades), rates, trades).select("sig", "parent")
    parents = first.unionByName(second)
    # The same words in another order, case or legal form.
    same = spelt.where("bag <> ''").select("bag", "sig").distinct()
    heads = same.groupBy("bag").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low < high").select("bag", "low")
    links = parents.select("sig", F.col("parent").alias("other")).unionByName(same.join(heads, "bag").where("sig > low").select("sig", F.col("low").alias("other")))
    ordered = links.select(F.greatest("sig", "other").alias("row_id"), F.least("sig", "other").alias("first")).distinct()
    roots = first_of_record(ordered).select(F.col("row_id").alias("sig"), F.col("first").alias("root"))
    return spelt.join(roots, "sig", "left").select("name", "n", F.coalesce("root", "sig").alias("party"), "stem")


def variant_pairs(linked: DataFrame) -> DataFrame:
    """(name_lo, name_hi): all pairs of different spellings of one party.

    A party's spellings are a few dozen; the pairs are asked for as such.
    """
    lo, hi = linked.select("party", F.col("name").alias("name_lo")), linked.select("party", F.col("name").alias("name_hi"))
    return lo.join(hi, "party").where("name_lo < name_hi").select("name_lo", "name_hi")
