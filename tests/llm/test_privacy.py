from keystrata.llm.privacy import candidates, disclosure, find_candidates, find_personal, redact

TEXTS = [
    "# Author: Vela Morrin <vela.morrin@post.example.org>\n# Written by Tam O'Brask, 2019-02-01\n",
    "// thanks to Vela K. Morrin for the patch\n// Quick Sort, Merge Join and Hash Ring\n// 10 LazyRing Street-like names are skipped\n",
    "call +44 (0)1632 960 129 or (415) 555-0134, part number 123-45-54 rev B, version 4.12.9\nfax ０１６３２ ９６００１２",
    "git@forge.test:a/b.git dsn://svc:pw9@db.a.test:5432/x needs ring-pack@3.2.1 or later",
    "write to vela.morrin [at] post [dot] example [dot] org or tam at post dot test; url https://x.test/u?mail=t.brask%40post.test&v=1",
    '{"ssn": "912-33-1234", "name": "Vela Morrin"}\n{"ssn": "99123456789", "name": "Ida van Holt"}',
    "INSERT INTO people VALUES (7, 'Vela', 'Morrin', '912 33 1234', '2019-01-01');",
    "office at 12 Old Morrin Way, Flat 3, Harholm, ZZ 01234 since 2010; Morrinstraße 12a, 12345 Harholm; P.O. Box 12, Harholm 12345",
    "# Copyright (c) 2019 Ringtunnel Labs\n# Copyright (c) 2019 Morrin, Vela <v@post.test>\n作者: ムトロ・ケラーリ",
    None,
    "",
    "   \n",
    "x" * 50000,
]


#: What the rest of a corpus says: words that stand before people, labels of numbers, streets with postcodes.
REST = [
    line.format(a=a, b=b, n=n)
    for n, (a, b) in enumerate([("Ovel", "Tamrick"), ("Sida", "Worlun"), ("Imre", "Falkset"), ("Uli", "Gretvan")])
    for line in (
        "/* Written by {a} {b} <{b}@post.test> */",
        "作者: {a} {b} {b}@post.test",
        "# Copyright (c) 2012 {b}, {a} <{b}@post.test>",
        '{{"ssn": "912-33-12{n}4", "name": "{a} {b}"}}',
        "INSERT INTO people VALUES ({n}, '{a}', '{b}', '912-33-123{n}', '2019-01-01');",
        "at {n}7 {b} Way, Harholm, ZZ 0123{n}",
    )
]


def places(spark, texts):
    rows = [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(REST))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'a' as kind", "1 as terms")
    return df, find_personal(df)


def test_finds_each_kind_and_leaves_the_rest(spark):
    df, found = places(spark, TEXTS)
    got = sorted((r.doc_id, r.kind, TEXTS[r.doc_id][r.start_char : r.end_char]) for r in found.filter("doc_id < 1000").collect())
    assert got == sorted(
        [
            (0, "email", "vela.morrin@post.example.org"),
            (0, "name", "Vela Morrin"),
            (0, "name", "Tam O'Brask"),
            (1, "name", "Vela K. Morrin"),
            (2, "phone", "+44 (0)1632 960 129"),
            (2, "phone", "(415) 555-0134"),
            (2, "phone", "０１６３２ ９６００１２"),
            (4, "email", "vela.morrin [at] post [dot] example [dot] org"),
            (4, "email", "tam at post dot test"),
            (4, "email", "t.brask%40post.test"),
            (5, "idnum", "912-33-1234"),
            (5, "idnum", "99123456789"),
            (5, "name", "Vela Morrin"),
            (5, "name", "Ida van Holt"),
            (6, "name", "Vela"),
            (6, "name", "Morrin"),
            (6, "idnum", "912 33 1234"),
            (7, "address", "12 Old Morrin Way, Flat 3, Harholm, ZZ 01234"),
            (7, "address", "Morrinstraße 12a, 12345 Harholm"),
            (7, "address", "P.O. Box 12, Harholm 12345"),
            (8, "email", "v@post.test"),
            (8, "name", "Morrin, Vela"),
            (8, "name", "ムトロ・ケラーリ"),
        ]
    )
    assert found.columns == ["doc_id", "kind", "start_char", "end_char"]


def test_text_with_placeholders_keeps_everything_else(spark):
    df, found = places(spark, TEXTS)
    out = {r.doc_id: r.text for r in redact(df, found).collect()}
    assert out[0] == "# Author: <NAME> <<EMAIL>>\n# Written by <NAME>, 2019-02-01\n"
    assert out[3] == TEXTS[3] and out[9] is None and out[10] == "" and out[12] == TEXTS[12]
    assert len(out) == len(TEXTS) + len(REST)


def test_words_often_seen_alone_are_public(spark):
    texts = ["# Author: Quick Sort\n"] + ["the Quick Sort is used"] * 300
    _, found = places(spark, texts)
    assert found.filter("doc_id < 1000").count() == 0


def test_terms_of_names_disclose_and_words_do_not(spark):
    df, _ = places(spark, TEXTS)
    bits = {r.term: r.bits for r in disclosure(find_candidates(df)).collect()}
    assert bits["n:morrin"] > 0 > bits["n:quick"]


def test_empty_table(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS[9:11])], "doc_id bigint, text string")
    assert find_personal(df).count() == 0 and disclosure(find_candidates(df)).count() == 0
    assert find_personal(df.limit(0)).count() == 0


def test_long_texts_of_every_kind_take_linear_time():
    import time

    from keystrata.llm.privacy import candidates

    parts = ["A. ", "Aa Bb ", "Aa-", "Aa, Bb, ", "123 456 789 ", "1", "a.", "x@", "(at)", "a at b dot ", "'a', ", "''", "+1 ", "12 Aa Street ", "12345678 ", "Aa 1 ", "name='Aa' ", "x@y.zz;", "x@y.zz Aa Bb ", "(1) ", "a@b.cc,1", "1 rue des ", "ア・", "author: ", '"name": "', "insert into a values ('b', "]
    began = time.process_time()
    for part in parts:
        candidates(part * (60_000 // len(part)))
    assert time.process_time() - began < 20


def test_forms_in_capitals_pass_the_prefilters():
    text = "FIRST_NAME=\"Vela\"\nLAST_NAME: 'Morrin'\nfirstName: 'Tam'"
    assert [text[c[1] : c[2]] for c in candidates(text) if c[0] == "name"] == ["Vela", "Morrin", "Tam"]
    for mail in ("JOE AT HOST DOT COM", "joe&COMMAT;host.test"):
        assert [(c[0], c[1], c[2]) for c in candidates(mail)] == [("email", 0, len(mail))]


def test_nothing_is_too_long_or_too_far_away():
    years = ", ".join(str(y) for y in range(1980, 2040))
    for text, name, before in (
        ("by A. B. C. D. E. Smith", "A. B. C. D. E. Smith", "c:by"),
        ("by John A. B. C. D. E. F. Smith, 2", "John A. B. C. D. E. F. Smith", "c:by"),
        (f"# Copyright (c) {years} Vela Morrin", "Vela Morrin", "c:copyright c"),
        (f"# written by {' ' * 500}: Vela Morrin", "Vela Morrin", "c:written by"),
        (f'"author{" " * 200}": "{"Ve" + "l" * 300} Morrin"', f'{"Ve" + "l" * 300} Morrin', "c:author"),
    ):
        assert [(text[c[1] : c[2]], before in c[5]) for c in candidates(text) if c[0] == "name" and "," not in c[5]] == [(name, True)]
    far = f'"first_name": "{"Ve" + "l" * 90}"; ssn {"." * 300} 912345678; x://{"a" * 200}:p@host.test'
    kinds = [(c[0], far[c[1] : c[2]][:4]) for c in candidates(far)]
    assert ("idnum", "9123") in kinds and ("name", "Vell") in kinds and not [k for k in kinds if k[0] == "email"]
    assert candidates("A. " * 20000) == []
    assert len(candidates("A. " * 20000 + "Smith")) == 1


def test_other_groupings_are_decided_by_their_labels(spark):
    texts = [f"phone: +44 20 7946 0{i}22" for i in range(100, 140)] + ["phone: 555 867 5309", "phone 1 800 555 0199", "phone=010-62345678", "timeout 555 867 5309", "ssn 2345 6789 0123", "width 2345 6789 0123"] + [f"ssn 912-33-1{i}" for i in range(200, 230)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {texts[r.doc_id]: (r.kind, texts[r.doc_id][r.start_char : r.end_char]) for r in find_personal(df).collect() if 40 <= r.doc_id < 46}
    assert got == {"phone: 555 867 5309": ("phone", "555 867 5309"), "phone 1 800 555 0199": ("phone", "1 800 555 0199"), "phone=010-62345678": ("phone", "010-62345678"), "ssn 2345 6789 0123": ("idnum", "2345 6789 0123")}


def test_streets_are_told_by_the_company_of_postcodes(spark):
    texts = [f"at {i} Morrin Gate, Harholm, ZZ 01234" for i in range(5)] + ["at 9 Vela Gate.", "has 9 Vela Buckets"] + [f"in Morrin{i % 2 * 'a'}weg 3, 12345 Harholm" for i in range(5)] + ["in Velaweg 9", "in Version 9"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {texts[r.doc_id]: texts[r.doc_id][r.start_char : r.end_char] for r in find_personal(df).filter("kind = 'address'").collect()}
    assert len(got) == 5 + 1 + 2 + 1 and got["at 9 Vela Gate."] == "9 Vela Gate" and got["in Velaweg 9"] == "Velaweg 9"


def test_places_over_one_another_are_settled(spark):
    texts = ["Morrin Falk Vela <morrin@post.test>, Morrin Falk <f@post.test>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = sorted((r.start_char, r.end_char) for r in find_personal(df).collect())
    assert spans and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_labelled_texts(spark):
    from labelled import measure

    for kind, (want, got, both) in measure(spark, 400).items():
        floor = {"email": 0.99, "address": 0.95, "phone": 0.9, "idnum": 0.6, "name": 0.6}[kind]
        assert both >= floor * want and both >= floor * got, kind
