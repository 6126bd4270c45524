from tallyloom.llm import pii
from tallyloom.llm.pii import name_chunks, names_in, personal_spans, sanitised, term, typed_spans

GIVEN = {"robert", "bjorn", "mei", "rene"}


def typed(text):
    return [(text[a:b], kind) for a, b, kind, _ in typed_spans(text)]


def test_typed():
    assert typed(r"mail x\_y@lab.ex-a.test, z [at] mail.b [dot] org or q AT m.c DOT test; \texttt{grid@3.1}") == [(r"x\_y@lab.ex-a.test", "email"), ("z [at] mail.b [dot] org", "email"), ("q AT m.c DOT test", "email")]
    for phone in ("+49 (0)30 23125 246", r"0044\,1632\,960\,701", "+33~1~99~00~40~12", "01.99.00.60.59", "030/23125-983", "(01632) 960 359", "202-555-0181", "+1 (202) 555-0194"):
        assert typed(f"Call {phone} now") == [(phone, "phone")]
    assert typed("SSN 954-59-2041, Steuer-ID: 14 920 161 745.") == [("954-59-2041", "id_number"), ("14 920 161 745", "id_number")]
    assert typed("ISBN 978-0-381-83194-7, serial 2657/815-B, pages 299--600, doi:10.50565/haf.238-8637") == []
    for street in ("163 bis, avenue Hafnade", "Calle Mepgier, 21", "Plaza de Sirnoov 33", "112b Norkidi St.", "Kedmeistr. 123", "Rapkeaweg~62c", "Hoxvisestraße 158", "103, rue des Gekpites"):
        assert typed(f"go to {street}, 86061 Town") == [(street, "street")]


def persons(text):
    out = []
    for at, chunk, company in name_chunks(text, typed_spans(text)):
        out += [text[at + a : at + b] for a, b in names_in(chunk, GIVEN, company)]
    return out


def test_persons():
    text = r"\author{Robert T. Vok \and Pifpa-Rel, Mei, Bj\"orn~von Kam\thanks{b@x.org} \and K. Zet}"
    assert persons(text) == ["Robert T. Vok", "Pifpa-Rel, Mei", r"Bj\"orn~von Kam", "K. Zet"]
    assert persons("Merci à F. Kampiker ainsi qu'à Robert Vok.") == ["F. Kampiker", "Robert Vok"]
    assert persons("See Section A. Models hold.") == []
    assert persons("By the Vok lemma, Robert ran. Frau RENÉ TAVI read it.") == ["RENÉ TAVI"]
    assert persons("\\begin{thebibliography}{9}\n\\bibitem{a} Robert Vok, x.\n\\end{thebibliography} RenÃ© Tavi") == ["RenÃ© Tavi"]
    assert term(r"S{\o}ren") == "soren" and term("RenÃ©") == "rene"


def test_whole_pass(spark, monkeypatch):
    surnames = ["Bakovel", "Demarin", "Fosteli", "Gurvano", "Hamokri", "Jelvoda", "Kuporna", "Lastevi", "Monkari", "Nervola", "Osteman", "Pelkuna"]
    rows = [(k, f"\\author{{Tomasz {s}\\thanks{{t{k}@x.example}}}}\nThe Satz von {s} holds. Zorn Tomasz fails. {'x ' * 2000}", "c") for k, s in enumerate(surnames)]
    rows += [(50, "% Tomasz Vokmer, phone +1 (202) 555-0194", "c"), (51, None, None), (52, "", ""), (None, "a@b.org", ""), (53, "nothing here", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lo string")
    spans = personal_spans(df).cache()
    got = {(r.doc_id, r.pii_type, r.pii_text) for r in spans.collect()}
    assert {(k, "person", f"Tomasz {s}") for k, s in enumerate(surnames)} <= got
    assert (50, "person", "Tomasz Vokmer") in got and (50, "phone", "+1 (202) 555-0194") in got
    assert not [g for g in got if g[0] in (51, 52, 53, None)]
    clean = {r.doc_id: r.text for r in sanitised(df).collect()}
    assert clean[52] == "" and clean[None] == "[EMAIL]" and clean[50] == "% [PERSON], phone [PHONE]" and clean[51] is None and clean[53] == "nothing here"
    assert personal_spans(df.limit(0)).count() == 0 and sanitised(df.limit(0)).count() == 0
    # A vocabulary too large for a set is joined; the result is the same.
    monkeypatch.setattr(pii, "BROADCAST_NAMES", 0)
    assert {(r.doc_id, r.pii_type, r.pii_text) for r in personal_spans(df).collect()} == got
    assert {r.doc_id: r.text for r in sanitised(df).collect()} == clean
