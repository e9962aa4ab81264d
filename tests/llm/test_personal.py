import pytest

from tracemill.llm.personal import MentionFinder, personal_mentions, redact_personal

LEXICON = ["Ann", "Bob", "Cyd", "Dora", "Lake", "Stone", "Harbor", "Reed"]


def kinds(text):
    return [(k, text[a:b]) for k, a, b, sure in MentionFinder(LEXICON).find(text) if sure]


@pytest.mark.parametrize(
    "text,want",
    [
        ("write to a.b+c@mail.example today", [("email", "a.b+c@mail.example")]),
        ("x [at] post [dot] q [dot] example or y(at)z.example", [("email", "x [at] post [dot] q [dot] example"), ("email", "y(at)z.example")]),
        ("ssh deploy@host.corp; git clone git@code.a.internal:x/y.git; npm i @a/b@1.2.3; p://u:w@h.example", []),
        ("call +49 30 23125 717 or (754) 555-0158, 585.555.0110, 0049-30-23125436, 07700 900406, +17355550196", [("phone", p) for p in ("+49 30 23125 717", "(754) 555-0158", "585.555.0110", "0049-30-23125436", "07700 900406", "+17355550196")]),
        ("order 666-6916-80, build 474.555.1487 at 10.150.197.131, invoice 0689-460-18386, 2026-01-02 03:04:05", []),
        ("SSN 666-66-8214 and 1929-815071-2 and QQ 76 42 49 C and 06686689-W and G6410-95443-07442", [("id_number", i) for i in ("666-66-8214", "1929-815071-2", "QQ 76 42 49 C", "06686689-W", "G6410-95443-07442")]),
        ("to 3473 Larkmoor Rd, Port Osken now", [("address", "3473 Larkmoor Rd, Port Osken")]),
        ("Flat 16, 145 Copperwane Terrace, Brackenhythe ZZ8 8QX is", [("address", "Flat 16, 145 Copperwane Terrace, Brackenhythe ZZ8 8QX")]),
        ("76 rue des Ajoncs, 00069 Dunmere, merci; Calle de la Noria 102, 2º B, 00232 Velgrave, el", [("address", "76 rue des Ajoncs, 00069 Dunmere"), ("address", "Calle de la Noria 102, 2º B, 00232 Velgrave")]),
        ("Torfstraße 2, 00436 Altmoorstadt und Am Mühlquell 221, 00114 Fennwick und P.O. Box 5, Dunmere 00250", [("address", "Torfstraße 2, 00436 Altmoorstadt"), ("address", "Am Mühlquell 221, 00114 Fennwick"), ("address", "P.O. Box 5, Dunmere 00250")]),
        ("83 lanes, 59 road tests and a street of mocks", []),
    ],
)
def test_structured_mentions(text, want):
    assert sorted(kinds(text)) == sorted(want)


def test_name_shapes():
    f = MentionFinder(LEXICON)
    names = lambda t: [t[a:b] for k, a, b, _ in f.find(t) if k == "name"]
    assert names("Passenger Ann Lake, DNI 1") == ["Ann Lake"]
    assert names("by Lake, Ann on") == ["Lake, Ann"] and names("Dr. A. Stone asked") == ["A. Stone"]
    assert names("Bob von der Reed owns") == ["Bob von der Reed"] and names("under ann stone for") == ["ann stone"]


def test_patterns_teach_unseen_names_and_not_services(spark, make_log):
    people = ["Ann Lake", "Bob Stone", "Cyd Reed", "Dora Lake", "Ann Reed", "Zed Quill", "Wyn Ash"]
    rows = [(f"r{i}", [f"The ticket was opened by {p} on behalf of us"]) for i, p in enumerate(people)] + [(f"s{i}", ["the Harbor Ledger service is down"]) for i in range(5)]
    rows += [("n1", None), ("n2", [None, "", ...]), (None, ["opened by Ann Lake on behalf"])]
    lex = spark.createDataFrame([(n, "given") for n in LEXICON] + [(None, None)], "name string, name_kind string")
    log = make_log(*rows, *rows[:2], extra=("kind", "text", "start", "pattern"))
    got = sorted(map(tuple, personal_mentions(log, lex).collect()))
    assert got == sorted((f"r{i}", 0, "name", p) for i, p in enumerate(people))
    assert personal_mentions(log.where("false"), lex).count() == 0
    assert personal_mentions(log, lex.where("false")).count() == 0


def test_redaction_keeps_the_rest(spark, make_log):
    lex = spark.createDataFrame([("Ann", "given")], "name string, name_kind string")
    log = make_log(("r", ["mail a@b.example or 585.555.0110 — thanks", "nothing here"]))
    assert [tuple(r) for r in redact_personal(log, lex).collect()] == [("r", 0, "mail [EMAIL] or [PHONE] — thanks", 2)]


def test_fields_teach_looser_forms(spark, make_log):
    """Strict phones and emails in a field teach the field; what else stands in it is found as well."""
    from tracemill.llm.personal import found_paths

    strict = [f'{{"msisdn": "+1 212 555 01{i:02}", "mail": "a{i}@mail{i}.example"}}' for i in range(8)]
    loose = ['{"msisdn": "555 01 22 33", "mail": "x9@home.corp"}', "port 555 01 22 44 at x@home.corp"]
    lexicon = spark.createDataFrame([("Ann", "given")], "name string, name_kind string")
    log = make_log(*[(f"r{i}", [t]) for i, t in enumerate(strict + loose)])
    got = {(r["request_id"], r["pii_type"], r["pii_text"]) for r in personal_mentions(log, lexicon).collect()}
    assert {("r8", "phone", "555 01 22 33"), ("r8", "email", "x9@home.corp")} <= got and not any(r == "r9" for r, _, _ in got)
    paths = {(r["pii_type"], r["path"]): r["n_mentions"] for r in found_paths(log, lexicon).collect()}
    assert paths == {("phone", "both"): 8, ("phone", "context"): 1, ("email", "both"): 8, ("email", "context"): 1}
