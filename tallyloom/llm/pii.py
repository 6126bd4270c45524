"""Personal information inside free text: information-theoretic sanitisation.

Addresses, numbers and streets are recognised by their form.  Names are not: a
capitalised pair of words is a name only if the corpus says so.  Every candidate
word is counted in name position over all documents, with and without a protected
entity beside it (an address or number in the same line, a title, an author block);
a word that leaves too few bits of doubt about a protected entity beside it, and which
goes with many different family names, acts as a given name.  Spans that disclose
are generalised to typed placeholders.

Texts are read once and never move: one pass writes what it found beside each document,
and where the words that disclose fit into a set, the second pass resolves (and masks)
row by row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut

# Words before a name that are no part of it.
TITLES = {"frau", "herr", "mr", "mrs", "ms", "mme", "mlle", "dr", "prof", "sr", "sra", "fam", "miss", "madame", "monsieur"}
#: Bits of surprise at a protected entity beside a word in name position, -log2 P(entity | word),
#: up to which the word discloses one.
MOST_SURPRISE = 2.75
#: Given names are sent to the tasks as a set up to so many, else joined as a table.
BROADCAST_NAMES = 200_000
#: Different family names a given name must go with.
LEAST_PARTNERS = 3
#: ... and, as it is met more often, this share of its positions, up to MANY_PARTNERS.
PARTNER_SHARE, MANY_PARTNERS = 0.25, 40
#: Characters around a candidate in which a protected entity counts as beside it.
REACH = 120

# ------------------------------------------------------------ typed entities

_LOCAL_TAIL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9.+%_-]|\\_)*$")
# How the sign is written in plain and in disguised addresses.
_AT_SIGNS = ("@", "[at]", "(at)", "{at}", "<at>", "[AT]", "(AT)", " AT ", " at ")
_DOT = r"(?:\.|[ ~]?(?:\[dot\]|\(dot\)|\{dot\}|<dot>|\[DOT\]|\(DOT\))[ ~]?| DOT | dot )"
_DOT_WORD = r"dot|DOT"
_DOMAIN = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9-]|\\_)*(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9])")

_GAP = r"(?:[ ~./-]|\\,|\\ )"
_PHONE = re.compile(
    rf"""(?<![\w.+/@-])(?:
      \+\d(?:{_GAP}?(?:\(\d{{1,4}}\)|\d)){{6,14}}                 # +49 (0)30 23125 246
    | 00[1-9]\d(?:{_GAP}?\d){{6,12}}                               # 0044\,1632\,960\,701
    | \(0\d{{2,5}}\)(?:{_GAP}?\d){{5,9}}                           # (01632) 960 359
    | \(\d{{3}}\){_GAP}?\d{{3}}{_GAP}\d{{4}}                       # (202) 555-0141
    | 0\d{{2,4}}/\d{{4,8}}(?:-\d{{1,5}})?                          # 030/23125-983
    | 0\d(?:[. ~-]\d\d){{4}}                                       # 01.99.00.60.59
    | \d{{3}}[.-]\d{{3}}[.-]\d{{4}}                                # 202-555-0181
    | 555[ ~-]\d{{4}}                                              # 555 0198
    )(?![\w/]|[.-]\d)""",
    re.X,
)
_ID_LABEL = re.compile(
    r"(?:SSN|[Ss]oc(?:ial|\.)[ ~]sec(?:urity|\.)(?:[ ~](?:number|no\.|nr\.))?|[Nn]ational[ ~]id(?:entity)?(?:[ ~](?:number|no\.|card))?|[Pp]ersonal[ ~](?:number|id|no\.)|[Mm]atriculation[ ~](?:number|no\.)"
    r"|[Ii]dentity[ ~]card(?:[ ~](?:number|no\.))?|[Pp]assport(?:[ ~](?:number|no\.|nr\.))?|DNI|NIE|NIF|NIR|[Tt]ax[ ~](?:id|ID|number|no\.)|Steuer-?(?:ID|Id|nummer)|[Ss]tudent[ ~](?:id|ID|number|no\.)"
    r"|Matrikel-?(?:nummer|nr\.|Nr\.)|Personalausweis(?:nummer|-?[Nn]r\.)?|Reisepass(?:nummer|-?[Nn]r\.)?|Sozialversicherungsnummer|[Ii]nsurance[ ~]number|NINO)"
    r"(?:[ ~]?[:=][ ~]?|[ ~])((?:[A-Z]{0,3}[0-9])[A-Z0-9]*(?:-[A-Z0-9]+|[ ~][0-9]{2,4}(?![0-9A-Za-z]|[ ~]*&))*)"
)
_BARE_ID = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")

_ACCENT = r"""(?:\\["'`^~=.]\{?[A-Za-z]\}?|\\[uvHcr]\{[A-Za-z]\}|\{\\["'`^~=.uvHcr] ?\{?[A-Za-z]\}?\}|\{\\(?:o|O|ss|ae|AE|aa|AA|l|L|i|oe|OE)\}|\\(?:o|O|ss|ae|aa|l|L)(?:\{\}|(?![A-Za-z])))"""
_GARBLED = "(?:[\u00c2-\u00c5][\u0080-\u00bf\u0152-\u0192\u02c6\u02dc\u2013-\u2122])"
_LETTER = rf"(?:{_GARBLED}|[^\W\d_]|{_ACCENT})"
_UPPER = rf"(?:{_GARBLED}|[A-Z\u00c0-\u00d6\u00d8-\u00de\u0106\u010c\u0141\u015a\u0160\u0179\u017b\u017d]|{_ACCENT})"
_WORD = rf"{_UPPER}{_LETTER}+"
_S = r"[ ~]"

# Parts of street names that start a closer look.
_STREET_SIGNS = (
    "straße", "strasse", "stra{\\ss", "stra\\ss", "straÃ", "str.", "weg", "gasse", "allee", "Calle", "Via", "Plaza", "Avenida", "Piazza", "Corso", "Rua", "Paseo",
    "rue", "avenue", "boulevard", "place", "quai", "chemin", "impasse", "Street", "Road", "Lane", "Avenue", "Close", "Terrace", "Drive", "Court", "Square", " St.", " Rd", " Ave.", " Ln", "~St.", "~Rd", "~Ave.",
)
_SMALL = r"(?:de la|de los|de las|del|des|de|du|della|di|la|le|las|los|les)"
_GERMAN_STREET = re.compile(rf"{_UPPER}{_LETTER}*?(?:stra(?:ß|ss|\{{\\ss\}}|\\ss(?:\{{\}}| )|ÃŸ|Ã\x9f)e|str\.|weg|gasse|allee){_S}\d{{1,4}}(?:{_S}?[a-z](?![\w]))?")
_ROMANCE_STREET = re.compile(rf"(?:Calle|Via|Plaza|Avenida|Piazza|Corso|Rua|Paseo){_S}(?:{_SMALL}{_S})*{_WORD}(?:-{_WORD})*(?:{_S}{_WORD})?,?{_S}\d{{1,4}}(?:{_S}bis|[a-z](?![\w]))?")
_FRENCH_STREET = re.compile(rf"(?<![\w-])\d{{1,4}}(?:{_S}(?:bis|ter|quater)|[a-z])?,{_S}?(?:rue|avenue|boulevard|place|quai|chemin|impasse|all[ée]e){_S}(?:{_SMALL}{_S}|[dl]')*{_WORD}(?:-{_WORD})*")
_ENGLISH_STREET = re.compile(rf"(?<![\w-])\d{{1,4}}[a-z]?{_S}{_WORD}(?:-{_WORD})*{_S}(?:Street|Road|Lane|Avenue|Close|Terrace|Drive|Court|Square|St\.|Rd\.?|Ave\.|Ln\.?)(?![\w])")

_BIB_BEGIN, _BIB_END = re.compile(r"\\begin\{thebibliography\}|\\bibitem"), "\\end{thebibliography}"


# Parts of labels of identity numbers that start a closer look.
_ID_SIGNS = ("SSN", "oc. sec", "oc.~sec", "ocial sec", "ocial~sec", "ational id", "ational~id", "ersonal ", "ersonal~", "atriculation", "dentity", "assport", "DNI", "NIE", "NIF", "NIR", "NINO", "ax id", "ax ID", "ax number", "ax no", "Steuer", "tudent id", "tudent ID", "tudent number", "tudent no", "Matrikel", "ersonalausweis", "Reisepass", "Sozialvers", "nsurance number")
_DIGIT_RUN = re.compile(r"[+(]?\d[\d().~/\\, -]{5,}\d")


def _places(text: str, signs: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """(start, end) of each literal in a text; finding literals is far cheaper than patterns."""
    for sign in signs:
        at = text.find(sign)
        while at >= 0:
            yield at, at + len(sign)
            at = text.find(sign, at + len(sign))


def typed_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, type, start with label) of e-mail addresses, phone and identity
    numbers and streets."""
    out: set[tuple[int, int, str, int]] = set()
    for lo, hi in _places(text, _AT_SIGNS):
        while lo and text[lo - 1] in " ~\\":
            lo -= 1
        while hi < len(text) and text[hi] in " ~":
            hi += 1
        head = _LOCAL_TAIL.search(text, max(0, lo - 80), lo)
        tail = _DOMAIN.match(text, hi)
        if head and tail:
            word = text[lo:hi].strip()
            if word in ("at", "AT") and not re.search(rf"{_DOT_WORD}", tail[0]) and word == "at":
                continue
            out.add((head.start(), tail.end(), "email", head.start()))
    for lo, _ in set(_places(text, _ID_SIGNS)):
        begin = max(0, lo - 1)
        m = _ID_LABEL.match(text, begin) or _ID_LABEL.match(text, lo)
        if m:
            out.add((m.start(1), m.end(1), "id_number", m.start()))
    taken = [(a, b) for a, b, *_ in out]
    free = lambda m: not any(a < m.end() and m.start() < b for a, b in taken)
    for run in _DIGIT_RUN.finditer(text):
        lo, hi = run.span()
        for m in _BARE_ID.finditer(text, lo, min(len(text), hi + 2)):
            if m.end() <= hi and free(m):
                out.add((m.start(), m.end(), "id_number", m.start()))
        for m in _PHONE.finditer(text, lo, min(len(text), hi + 2)):
            if m.end() <= hi and free(m):
                out.add((m.start(), m.end(), "phone", m.start()))
    streets: list[tuple[int, int]] = []
    for at, past in sorted(set(_places(text, _STREET_SIGNS))):
        if streets and at < streets[-1][1]:
            continue
        lo, hi = max(0, at - 60), min(len(text), past + 80)
        for shape in (_GERMAN_STREET, _FRENCH_STREET, _ROMANCE_STREET, _ENGLISH_STREET):
            found = next((m for m in shape.finditer(text, lo, hi) if m.start() < past and at < m.end()), None)
            if found:
                streets.append(found.span())
                break
    out.update((a, b, "street", a) for a, b in streets)
    return sorted(out)


# -------------------------------------------------------------------- names

_INITIAL = r"[A-Z\u00c0-\u00de]\."
_PIECE = re.compile(rf"(?P<init>{_INITIAL})(?!{_LETTER})|(?P<word>(?:al-|d'|de~)?{_WORD}(?:-{_WORD}|['’][A-Z]{_LETTER}+)*)")
_LINK = r"(?:,?[ ~]|,~)"
_PARTICLE = r"(?:(?:von|van|de|der|den|del|della|di|da|dos|la|le|zu|ten|ter)[ ~])"
_CHUNK = re.compile(rf"(?:{_INITIAL}|(?<![\w\\{{}}])(?:{_WORD}(?:-{_WORD}|['’][A-Z]{_LETTER}+)*)|(?<=\{{)(?:{_WORD}(?:-{_WORD})*))(?:(?:{_LINK}|(?<=\.)){_PARTICLE}*(?:al-)?(?:{_INITIAL}|{_WORD}(?:-{_WORD}|['’][A-Z]{_LETTER}+)*))+")
_SPLIT = re.compile(rf"(?P<link>{_LINK}?)(?P<part>{_PARTICLE}*)(?P<al>(?:al-)?)(?:(?P<init>{_INITIAL})(?!{_LETTER})|(?P<word>{_WORD}(?:-{_WORD}|['’][A-Z]{_LETTER}+)*))")
_AUTHOR = re.compile(r"\\author\b|\\and\b|\\thanks\b|\\address\b|\\email\b|last edit ")
# Words of thanks, after which persons are named.
_THANKS = re.compile(r"(?i)\b(?:thank|merci|remerci|danken|gracias|agradec|grateful|indebted)")


@lru_cache(maxsize=100_000)
def term(word: str) -> str:
    """A word as it is counted: markup, wrong decoding, case and marks undone."""
    if word.isascii() and word.isalpha():
        return word.lower()
    word = re.sub(r"\\(?:o|O)(?![a-zA-Z])", "o", word)
    word = re.sub(r"\\(?:ss)(?![a-zA-Z])", "ss", word)
    word = re.sub(r"\\(?:l|L)(?![a-zA-Z])", "l", word)
    word = re.sub(r"\\[uvHcr](?=\{)", "", word)
    word = re.sub(r"""\\["'`^~=.]|[{}]|\\""", "", word)
    for codec in ("latin-1", "cp1252"):
        try:
            word = word.encode(codec).decode("utf-8")
            break
        except UnicodeError:
            continue
    flat = unicodedata.normalize("NFKD", word.casefold().replace("ø", "o").replace("ł", "l"))
    return "".join(c for c in flat if not unicodedata.combining(c))


def pieces(chunk: str) -> list[tuple[str, str, str, int, int, int]]:
    """(kind, link before, word, start, start with particles, end) along a chunk."""
    out, at = [], 0
    while at < len(chunk):
        m = _SPLIT.match(chunk, at)
        if not m or m.end() == at:
            break
        kind = "i" if m["init"] else "w"
        word = m["init"] or m["word"]
        start = m.start("init") if m["init"] else m.start("word")
        out.append((kind, m["link"], word, start, m.start("part"), m.end()))
        at = m.end()
    return out


def bibliography(text: str) -> list[tuple[int, int]]:
    """Spans of bibliographies; one without end runs to the end of the text."""
    out, at = [], 0
    if "thebibliography" not in text and "\\bibitem" not in text:
        return out
    while m := _BIB_BEGIN.search(text, at):
        if m[0].startswith("\\begin"):
            end = text.find(_BIB_END, m.end())
            at = len(text) if end < 0 else end
        else:
            ends = [k for k in (text.find("\n\n", m.end()), text.find("\r\n\r\n", m.end()), text.find(_BIB_END, m.end())) if k >= 0]
            at = min(ends, default=len(text))
        out.append((m.start(), at))
    return out


def name_chunks(text: str, typed: list[tuple[int, int, str, int]]) -> list[tuple[int, str, bool]]:
    """(offset, chunk, company): runs of capitalised words outside bibliographies.

    ``company`` tells whether a protected entity, an author block, a title or a word of
    thanks is beside.
    """
    out = []
    closed = sorted([(a, b) for _, b, _, a in typed] + bibliography(text))
    free, at = [], 0
    for a, b in closed:
        if a > at:
            free.append((at, a))
        at = max(at, b)
    free.append((at, len(text)))
    for lo, hi in free:
        for m in _CHUNK.finditer(text, lo, hi):
            begin = max(text.rfind("\n", 0, m.start()), text.rfind("\r", 0, m.start())) + 1
            stop = text.find("\n", m.end())
            stop = len(text) if stop < 0 else stop
            beside = any(a < min(stop, m.end() + REACH) and b > max(begin, m.start() - REACH) for a, b, *_ in typed)
            titled = text[max(0, m.start() - 6) : m.start()].rstrip(" ~.").casefold().split(" ")[-1].strip("~.") in TITLES
            block = bool(_AUTHOR.search(text, begin, m.start()))
            thanked = bool(_THANKS.search(text, max(begin, m.start() - 80), m.start()))
            out.append((m.start(), m[0], beside or titled or block or thanked))
    return out


def name_positions(chunk: str) -> list[tuple[str, str | None]]:
    """(term, partner term) of each word that stands before another, where a given name
    would; words that may be a given name after a comma have no partner."""
    ps = pieces(chunk)
    out: list[tuple[str, str | None]] = []
    for k, (kind, link, word, *_rest) in enumerate(ps):
        if kind != "w" or term(word) in TITLES:
            continue
        j = k + 1
        while j < len(ps) and ps[j][0] == "i" and not ps[j][1].startswith(","):
            j += 1
        if j < len(ps) and ps[j][0] == "w" and not ps[j][1].startswith(","):
            out.append((term(word), term(ps[j][2])))
        elif k and link.startswith(","):
            out.append((term(word), None))
    return out


def names_in(chunk: str, given: set[str], company: bool) -> list[tuple[int, int]]:
    """Spans of persons in a chunk, where ``given`` are the terms that disclose one."""
    ps = pieces(chunk)
    is_given = [kind == "w" and term(word) in given for kind, _, word, *_ in ps]
    glued = lambda j: j < len(ps) and not ps[j][1].startswith(",")
    out, k = [], 0
    while k < len(ps):
        kind, _, _, start, _, end = ps[k]
        j = k + 1
        if is_given[k]:
            while glued(j) and (ps[j][0] == "i" or (is_given[j] and glued(j + 1) and ps[j + 1][0] == "w")):
                j += 1
            if glued(j) and ps[j][0] == "w":
                out.append((start, ps[j][5]))
                k = j + 1
                continue
        elif kind == "w" and j < len(ps) and ps[j][1].startswith(",") and is_given[j]:
            n = j + 1
            while glued(n) and ps[n][0] == "i":
                n += 1
            if not (glued(n) and ps[n][0] == "w"):
                out.append((ps[k][4], ps[n - 1][5]))
                k = n
                continue
        elif kind == "w" and j < len(ps) and ps[j][1].startswith(",") and ps[j][0] == "i" and company:
            n = j + 1
            while glued(n) and ps[n][0] == "i":
                n += 1
            if not (glued(n) and ps[n][0] == "w"):
                out.append((ps[k][4], ps[n - 1][5]))
                k = n
                continue
        elif kind == "i" and company:
            while glued(j) and ps[j][0] == "i":
                j += 1
            if glued(j) and ps[j][0] == "w":
                out.append((start, ps[j][5]))
                k = j + 1
                continue
        k += 1
    return out


# -------------------------------------------------------------------- Spark


#: Characters of text whose findings are handed on at a time.
GROUP_CHARS = 500_000
_TYPED = pa.struct([("kind", pa.string()), ("lo", pa.int32()), ("hi", pa.int32()), ("span", pa.string())])
_CHUNKS = pa.struct([("lo", pa.int32()), ("chunk", pa.string()), ("company", pa.bool_()), ("terms", pa.list_(pa.string())), ("partners", pa.list_(pa.string()))])
_SCAN = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("typed", pa.list_(_TYPED)), ("chunks", pa.list_(_CHUNKS))])
_SCAN_DDL = "doc_id long, text string, typed array<struct<kind: string, lo: int, hi: int, span: string>>, chunks array<struct<lo: int, chunk: string, company: boolean, terms: array<string>, partners: array<string>>>"


def _found(text: str) -> tuple[list[dict], list[dict]]:
    """Typed spans, and name candidates with the words in name position (a null partner: only
    after a comma)."""
    typed = typed_spans(text)
    chunks = []
    for at, chunk, company in name_chunks(text, typed):
        positions = name_positions(chunk)
        if positions or company:
            chunks.append({"lo": at, "chunk": chunk, "company": company, "terms": [t for t, _ in positions], "partners": [p for _, p in positions]})
    return [{"kind": kind, "lo": a, "hi": b, "span": text[a:b]} for a, b, kind, _ in typed], chunks


def _scanner(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCAN, strict=True)], schema=_SCAN)
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                rows.append((key.as_py(), text if with_text else None, *(_found(text) if text else ([], []))))
                size += len(text or "")
                if size >= GROUP_CHARS:
                    yield pack()
                    rows, size = [], 0
        if rows:
            yield pack()

    return run


def scan(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, text, typed, chunks): one pass over the whole texts.

    Without ``with_text`` documents of null id, null or empty text are left out, and the
    text is not handed on.
    """
    texts = documents if with_text else documents.where("doc_id is not null and text is not null and text <> ''")
    return texts.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scanner(with_text), _SCAN_DDL)


def _positions(scanned: DataFrame) -> DataFrame:
    """(term, partner, company) of each word before another, where a given name would stand."""
    chunks = scanned.where("doc_id is not null").select(F.explode("chunks").alias("c"))
    return chunks.select(F.explode(F.arrays_zip("c.terms", "c.partners")).alias("p"), F.col("c.company").cast("long").alias("company")).select(F.col("p.terms").alias("term"), F.col("p.partners").alias("partner"), "company").where("partner is not null")


def disclosure(scanned: DataFrame) -> DataFrame:
    """(term, positions, company, partners, bits, surprise): what each candidate word reveals.

    ``bits`` is the pointwise mutual information, over all documents, of the word in
    name position and a protected entity beside it; ``surprise`` the bits that are left of
    doubt about such an entity, null where there never was one.  Counts are folded before
    they move, so a name on a third of all pages is one row a task.
    """
    pairs = _positions(scanned).groupBy("term", "partner").agg(F.count("*").alias("positions"), F.sum("company").alias("company"))
    per_term = pairs.groupBy("term").agg(F.sum("positions").alias("positions"), F.sum("company").alias("company"), F.count("*").alias("partners"))
    base = per_term.agg((F.sum("company") / F.sum("positions")).alias("base"))
    share = F.nullif(F.col("company") / F.col("positions"), F.lit(0.0))
    return per_term.crossJoin(F.broadcast(base)).select("term", "positions", "company", "partners", F.log2(share / F.nullif("base", F.lit(0.0))).alias("bits"), (-F.log2(share)).alias("surprise"))  # one row


def given_names(scanned: DataFrame, most_surprise: float, least_partners: int) -> DataFrame:
    """(term): the words that disclose a person.

    A word mostly followed by other such words (a verb or a title before full names)
    is none itself.
    """
    enough = F.greatest(F.lit(least_partners), F.least(PARTNER_SHARE * F.col("positions"), F.lit(MANY_PARTNERS)))
    first = cut(disclosure(scanned).where((F.col("surprise") <= most_surprise) & (F.col("partners") >= enough)).select("term", "positions"), "pii-terms")
    before = _positions(scanned).groupBy("term", "partner").count()
    leading = before.join(first.select(F.col("term").alias("partner")), "partner").groupBy("term").agg(F.sum("count").alias("leads"))
    return first.join(leading, "term", "left").where("coalesce(leads, 0) < 0.5 * positions").select("term")


_SPANS_DDL = "doc_id long, pii_type string, pii_text string, lo long, hi long"


def _persons(chunks: list[dict] | None, given: frozenset[str]) -> Iterator[tuple[str, int, int]]:
    for c in chunks or ():
        known = given.intersection(c["terms"])
        if known or c["company"]:
            for a, b in names_in(c["chunk"], known, c["company"]):
                yield c["chunk"][a:b], c["lo"] + a, c["lo"] + b


def _spans_of(row: dict, given: frozenset[str]) -> list[tuple[str, str, int, int]]:
    """(type, text, lo, hi) of all personal data of a scanned document."""
    typed = [(t["kind"], t["span"], t["lo"], t["hi"]) for t in row["typed"] or ()]
    return typed + [("person", *p) for p in _persons(row["chunks"], given)]


def _with_given(scanned: DataFrame, most_surprise: float, least_partners: int) -> tuple[DataFrame, Callable[[dict], frozenset[str]], list[str]]:
    """The scanned rows, how to tell the given names of one, and the columns for it.

    A set of a counted size goes to all tasks; a larger table is joined to the words of the
    documents, which then carry their given names as a column.
    """
    terms = cut(given_names(scanned, most_surprise, least_partners), "pii-given")
    if terms.count() <= BROADCAST_NAMES:
        shared = scanned.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in terms.collect()))
        return scanned, lambda row: shared.value, []
    words = scanned.select("doc_id", F.explode("chunks.terms").alias("t")).select("doc_id", F.explode("t").alias("term")).distinct()
    known = words.join(terms, "term").groupBy("doc_id").agg(F.collect_list("term").alias("given"))  # of one document
    return scanned.join(known, "doc_id", "left"), lambda row: frozenset(row["given"] or ()), ["given"]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """A few documents at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield batch.slice(at, 64).to_pylist()


def _batched(out: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(schema), schema, strict=True)], schema=schema)


def personal_spans(documents: DataFrame, most_surprise: float = MOST_SURPRISE, least_partners: int = LEAST_PARTNERS) -> DataFrame:
    """(doc_id, pii_type, pii_text, lo, hi): all personal data with their offsets.

    Types are email, phone, id_number, street and person.  Documents with a null id,
    null or empty text have none.  Offsets count code points.  Whole texts are read,
    comments and disabled parts too; names inside bibliographies are left out.  The
    words that act as given names come from counts over all documents.
    """
    scanned, given, more = _with_given(cut(scan(documents), "pii-scan"), most_surprise, least_partners)
    schema = pa.schema([("doc_id", pa.int64()), ("pii_type", pa.string()), ("pii_text", pa.string()), ("lo", pa.int64()), ("hi", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches):
            yield _batched([(row["doc_id"], *s) for row in rows for s in _spans_of(row, given(row))], schema)

    return scanned.select("doc_id", "typed", "chunks", *more).mapInArrow(run, _SPANS_DDL)


#: What stands in place of each type.
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "street": "[STREET]", "person": "[PERSON]"}


def masked(text: str, spans: list[tuple[str, str, int, int]]) -> str:
    """The text with a placeholder for each span; of overlapping ones the first and longest."""
    out, at = [], 0
    for kind, _, lo, hi in sorted(spans, key=lambda s: (s[2], -s[3])):
        if lo >= at:
            out += [text[at:lo], PLACEHOLDERS[kind]]
            at = hi
    return "".join(out) + text[at:]


def sanitised(documents: DataFrame, most_surprise: float = MOST_SURPRISE, least_partners: int = LEAST_PARTNERS) -> DataFrame:
    """(doc_id, text) with a typed placeholder in each place; other text unchanged, null and
    empty texts too.

    The first pass hands each text on beside what it found in it, so the second one masks
    where the text lies.
    """
    scanned, given, more = _with_given(cut(scan(documents, True), "pii-scan"), most_surprise, least_partners)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches):
            yield _batched([(row["doc_id"], row["text"] and masked(row["text"], _spans_of(row, given(row)))) for row in rows], schema)

    return scanned.select("doc_id", "text", "typed", "chunks", *more).mapInArrow(run, "doc_id long, text string")
