from collections import Counter

from util import same

from contextloom.llm import licenses as L

MIT = [L.SENTENCES[k] for k in ("mit-grant", "mit-notice-kept", "mit-asis", "mit-liability")]
BSD3 = [L.SENTENCES[k] for k in ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")]


def wrapped(text, n=60):
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) > n:
            out.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return "\n".join([*out, line])


def test_rules_follow_order(spark):
    texts = {
        1: wrapped(" ".join(MIT)), 2: "\n".join(BSD3), 3: "\n".join(BSD3[:3]), 4: "\n".join([BSD3[1], BSD3[0], BSD3[2]]), 5: "prose.\nLicensed under CC BY-NC 4.0.\nmore | prose",
        6: "Released under the MIT License. And then: licensed under the apache license, version 2.0!", 7: "no permission here; a licence nobody knows.", 8: None, 9: "",
        10: MIT[0].upper() + "\n\n" + MIT[1],
    }
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in texts.items()], "doc_id long, text string, a int, t string")
    got = {r.doc_id: r.licenses for r in L.scan(df).collect()}
    assert got == {1: "MIT", 2: "BSD-3-Clause", 3: "BSD-2-Clause", 4: "", 5: "CC-BY-NC-4.0", 6: "Apache-2.0,MIT", 7: "", 8: "", 9: "", 10: "MIT"}


def test_documents_equal_sql(spark, duck):
    same(L.op10(spark, "/root/testdata/sf0.001").toPandas(), duck.execute(L.oracle()).df())


def test_messy_rows(messy, messy_rows, nothing):
    assert Counter(r.doc_id for r in L.scan(messy).collect()) == Counter(r[0] for r in messy_rows)
    assert L.scan(nothing).count() == 0


def test_the_tables_are_sound():
    assert all(any(c in s.lower() for c in L.CUES) for s in L.SENTENCES.values())
    assert {i for _, ids in L.RULES for i in ids} <= set(L.SENTENCES) and len({L.normalise(s) for s in L.SENTENCES.values()}) == len(L.SENTENCES)


def test_every_rule_finds_its_own_text(spark):
    texts = [(k, name, sep.join(form(L.SENTENCES[i]) for i in ids)) for k, (name, ids, sep, form) in enumerate((n, i, s, f) for n, i in L.RULES for s, f in (("\n", str), ("\n\n", wrapped)))]
    df = spark.createDataFrame([(k, t) for k, _, t in texts], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in L.scan(df).collect()}
    assert got == {k: name for k, name, _ in texts}
    assert {i for _, ids in L.RULES for i in ids} == set(L.SENTENCES)


def test_a_divided_sentence_counts_once_and_only_whole(spark):
    gpl = [L.SENTENCES[k] for k in ("gpl-redistribute", "gpl-hope", "gpl-implied", "gpl-see")]
    mpl = L.SENTENCES["mpl2-notice"]
    header = wrapped(f"{gpl[0]} {gpl[1]}; {gpl[2]} {gpl[3]}")
    texts = [header, f"{mpl} {mpl}", mpl.replace("2.0", "1.1"), "A license. 2.0. This program is free software: it is.", f"{MIT[0]} 2.0. {MIT[1]}", mpl.replace("v. 2.0", "v. or so. 2.0")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r)[1:4] for r in L.scan(df).orderBy("doc_id").collect()]
    assert got == [(4, "gpl-redistribute,gpl-hope,gpl-implied,gpl-see", "GPL-3.0"), (2, "mpl2-notice,mpl2-notice", "MPL-2.0"), (0, "", ""), (0, "", ""), (2, "mit-grant,mit-notice-kept", "MIT"), (0, "", "")]
