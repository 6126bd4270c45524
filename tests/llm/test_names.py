from tallyloom.llm.names import RATES, estimated_rates, likelihood, link_names, one_edit, signature, variant_pairs

SAME = [
    ["Norsabiksir General Energy Ltd", "Nrsabiksir General Energy Ltd", "NORSABIKSIR GE LTD", "Norsa biksir General Nrg Ltd", "Norsabiksir, General Energy", "Energy Norsabiksir General Ltd", "norsabiksir gen. energy limited"],
    ["Norsabiksir National Engineering GmbH", "Norsabiksir Nat. Engrg G.m.b.H."],
    ["Patricia J. Gekledarbán", "Pat Gekeldarbán", "Gekledarbán, P. J.", "MS PATRICIA GEKLEDARBAN"],
    ["William Gekledarbán", "Bill Gekledarbán", "Fam. William Gekldarbán", "W. Gekledarbán"],
]


def linked(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    return {r.name: r.party for r in link_names(df).collect()}


def test_edits():
    assert one_edit("abcd", "abdc") and one_edit("abc", "abcd") and one_edit("abc", "adc") and one_edit("a", "")
    assert not one_edit("abc", "abc") and not one_edit("abcd", "dcba") and not one_edit("ab", "abcd")


def test_signatures():
    assert signature("Fovzehafpev, J. A.")["letters"] == "j"
    assert signature("Totfogasniz Labs Oy Ab")["kind"] == "F"
    assert signature("...") is None
    a, b = signature("Dora Kedkenegdar"), signature("Dorothea Kedkenegdar")
    assert likelihood(a, b) > -20
    assert likelihood(signature("Robert Kedkenegdar"), b) == float("-inf")


def test_parties(spark):
    names = [n for group in SAME for k, n in enumerate(group) for _ in range(30 if k == 0 else 2)]
    got = linked(spark, [*names, None, "?", "N/A", "UNKNOWN", "", "x" * 3000])
    assert not {"?", "N/A", "UNKNOWN"} & set(got)
    for group in SAME:
        assert len({got[n] for n in group}) == 1, group
    assert len({got[g[0]] for g in SAME}) == len(SAME)


def test_pairs_are_ordered_and_whole(spark):
    df = spark.createDataFrame([(n,) for n in SAME[0] * 3], "name string")
    pairs = {tuple(r) for r in variant_pairs(link_names(df)).collect()}
    assert len(pairs) == len(SAME[0]) * (len(SAME[0]) - 1) // 2 and all(a < b for a, b in pairs)


def test_empty(spark):
    assert linked(spark, []) == {}


# Trades and given names that no list of the module has.
UNLISTED = [
    ["Plinvork Quarrying GmbH", "PLINVORK QUARRYING", "Plinvork Quarring GmbH", "Plinvork Quarr. GmbH"],
    ["Harbeltan Catering Ltd", "Catering Harbeltan Ltd", "Harbeltan Catering", "Harbeltan Catering S.A."],
    ["Anthony Vexelmark", "Tony Vexelmark", "VEXELMARK, ANTHONY", "A. Vexelmark"],
    ["Benjamin Ostrakulen", "Ben Ostrakulen", "Ostrakulen Benjamin", "Mr Benjamin Ostrakuln"],
    ["Thorvaldine Meskabrun", "Thor Meskabrun", "Meskabrun, Thorvaldine"],
]


def test_invented_vocabulary(spark):
    brands = ["Ablokan", "Bredisum", "Cralivon", "Drofteki", "Elmovart", "Frunakos", "Gristole", "Hulbamen", "Irvoklat", "Jastrebo", "Krilomun", "Lubdaresk"]
    names = [n for group in UNLISTED for k, n in enumerate(group) for _ in range(9 if k == 0 else 1)]
    names += [f"{b} {t} Ltd" for b in brands for t in ("Quarrying", "Catering") for _ in range(3)]
    got = linked(spark, names)
    pairs = [(x, y) for group in UNLISTED for x in group for y in group if x < y]
    assert sum(got[x] == got[y] for x, y in pairs) >= 0.9 * len(pairs), [p for p in pairs if got[p[0]] != got[p[1]]]
    assert len({got[g[0]] for g in UNLISTED}) == len(UNLISTED)
    assert len({got[f"{b} {t} Ltd"] for b in brands for t in ("Quarrying", "Catering")}) == 2 * len(brands)


def test_estimates_stay_near_the_guess(spark):
    attached = spark.createDataFrame([(90, ["typo"]), (10, ["no legal", "typo"])], "n long, changes array<string>")
    rates = estimated_rates(attached, 1000)
    assert abs(rates["typo"] - RATES["typo"] * 5) < 1e-9 and rates["no legal"] == RATES["no legal"] / 5
