from collections import defaultdict

from util import same

from contextloom.llm import preference as C


def render(t):
    return f"<|im_start|>{t[0]}\n{t[1]}<|im_end|>\n"


def plain(rows):
    sides = defaultdict(lambda: {"chosen": [], "rejected": []})
    for pair, side, turn, role, text in rows:
        if pair is None:  # belongs to no pair
            continue
        sides[pair][side].append((turn, role or "unknown", text or ""))
    out = {}
    for pair, s in sides.items():
        a, b = ([x[1:] for x in sorted(s[k])] for k in ("chosen", "rejected"))
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        masks = []
        for side in (a, b):
            at, spans = 0, []
            for role, text in side[n:]:
                size = len(render((role, text)))
                if role == "assistant":
                    head = len(f"<|im_start|>{role}\n")
                    spans.append(f"{at + head}:{at + size - 1}")
                at += size
            masks.append(",".join(spans))
        out[pair] = (n, *("".join(map(render, x)) for x in (a[:n], a[n:], b[n:])), *masks)
    return out


def found(df):
    return {r.pair_id: (r.n_prefix, r.prompt, r.chosen, r.rejected, r.chosen_mask, r.rejected_mask) for r in df.collect()}


ROWS = [
    (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes é"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no"), (1, "rejected", 2, "user", None),
    (2, "chosen", 0, None, "x"), (3, "rejected", 5, "assistant", ""), (4, "chosen", 0, "user", "a"), (4, "rejected", 0, "user", "a"),
    (5, "chosen", 0, "user", "a"), (5, "chosen", 0, "user", "a"), (5, "rejected", 0, "user", "a"), (5, "rejected", 1, "assistant", "w " * 9000), (None, "chosen", None, None, None),
]


def test_pairs_equal_the_plain_restatement(spark):
    df = spark.createDataFrame([(*r, 7) for r in ROWS], "pair_id long, side string, turn long, role string, text string, k int")
    assert found(C.format_pairs(df)) == {k: v for k, v in plain([(*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in ROWS]).items()}
    assert C.format_pairs(df.where("false")).count() == 0


def test_masks_mark_what_the_assistant_says(spark):
    df = spark.createDataFrame([(*r,) for r in ROWS], "pair_id long, side string, turn long, role string, text string")
    r = C.format_pairs(df).where("pair_id = 1").first()
    a, b = map(int, r.chosen_mask.split(":"))
    assert r.prompt == render(("user", "hi")) and r.chosen[a:b] == "yes é<|im_end|>"


def test_conversations_equal_sql(spark, duck):
    got = C.op8(spark, "/root/testdata/sf0.001")
    same(got.toPandas(), duck.execute(C.OP8_SQL).df())
    assert got.where("n_prefix > 0 and chosen != rejected").count() > 0


def test_swapped_on_messy_conversations(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (1, 0, "assistant", None), (2, 0, "user", "only"), (4, 0, "assistant", "x"), (4, 0, "assistant", "y"), (5, 1, "assistant", "five"), (None, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = found(C.format_pairs(C.swapped(df)))
    assert got[0][3] == render(("assistant", "")) and got[1][3] == render(("assistant", "a0")) and got[2][0] == 1 and set(got) == {0, 1, 2, 4, 5}
    assert [tuple(r) for r in C.unpaired(df, "conv_id").collect()] == [(None, 0, "user", "z")]


def test_columns_of_clashing_names_are_no_matter(spark):
    names = ["said", "end", "k", "a", "b", "n", "start", "prompt", "chosen", "s", "last", "at", "other"]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in ROWS], "pair_id long, side string, turn long, role string, text string, " + ", ".join(f"{x} int" for x in names))
    assert found(C.format_pairs(df)) == found(C.format_pairs(df.drop(*names)))
    turns = df.where("side = 'chosen'").drop("side").withColumnRenamed("pair_id", "conv_id").withColumn("pair_id", df.k).withColumn("side", df.k)
    assert found(C.format_pairs(C.swapped(turns))) == found(C.format_pairs(C.swapped(turns.select("conv_id", "turn", "role", "text"))))
