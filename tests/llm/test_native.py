"""Line dedup, pseudonyms and chat rotation: the DataFrame-only operators."""

import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from querent.llm import chat, line_dedup, pii, queries


def plan_of(df):
    return df._jdf.queryExecution().toString()


# -- line dedup


def mask(line):
    return " ".join(re.sub(r"\S*\d\S*", "<*>", w) for w in line.split())


def brute_lines(spark, rows, min_docs, min_tokens, depth, similar):
    """The lines (row, position) that go, by hand: in each leaf, commonest lines first, each joins the first template it resembles."""
    at = [(i, d, p, mask(x)) for i, (d, t) in enumerate(rows) if t is not None for p, x in enumerate(t.split("\n"))]
    at = [x for x in at if len(x[3].split()) >= min_tokens]
    docs = defaultdict(set)
    for _, d, _, m in at:
        docs[m].add(d)
    order = {r.m: r.h for r in spark.createDataFrame([(m,) for m in docs], "m string").select("m", F.xxhash64("m").alias("h")).collect()} if docs else {}
    leaves, template = defaultdict(list), {}
    for m in sorted(docs, key=lambda m: (-len(docs[m]), -order[m])):
        words = m.split()
        heads = leaves[len(words), tuple(words[:depth])]
        same = [h for h in heads if sum(a == b for a, b in zip(h.split(), words, strict=True)) >= similar * len(words)]
        template[m] = same[0] if same else m
        if not same:
            heads.append(m)
    holders = defaultdict(set)
    for _, d, _, m in at:
        holders[template[m]].add(d)
    first = {t: min(h, key=lambda d: (d is None, d)) for t, h in holders.items()}
    return {(i, p) for i, d, p, m in at if len(holders[template[m]]) >= min_docs and d != first[template[m]]}


def same_as_brute(spark, rows, **params):
    """The lines that go by hand, after checking that the operator drops just these."""
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, at int")
    out = {r["at"]: r for r in line_dedup.drop_recurring_lines(df, **params).collect()}
    gone = brute_lines(spark, rows, params.get("min_docs", 10), params.get("min_tokens", 3), params.get("depth", 3), params.get("similar", 0.7))
    for i, (_, t) in enumerate(rows):
        assert out[i].text == (None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)), i
        assert out[i].n_lines_dropped == len({p for j, p in gone if j == i})
    return gone


@pytest.mark.parametrize("keep_first", [True, False])
def test_recurring_templates_go(spark, keep_first):
    rows = []
    for i in range(6):
        rows.append((i, f"{'abcdef'[i]} line of {'qwerty'[i] * 3} own words here\nReleased version 1.{i} of the work today\n\nshort one"))
    rows += [(10, "Released version 9.9 of the work today"), (11, "Released version alpha of the work tomorrow evening then"), (12, None), (13, ""), (14, "Released version 7 of another work today")]
    df = spark.createDataFrame([(i, t, 5, "k") for i, t in rows], "doc_id long, text string, n_lines_dropped int, pos string")
    out = {r.doc_id: r for r in line_dedup.drop_recurring_lines(df, min_docs=4, keep_first=keep_first).collect()}
    assert len(out) == len(rows) and out[12].text is None and out[13].text == "" and out[0].pos == "k"
    gone = sorted(i for i in out if out[i].n_lines_dropped)
    assert gone == ([1, 2, 3, 4, 5, 10, 14] if keep_first else [0, 1, 2, 3, 4, 5, 10, 14])
    assert "Released" not in out[3].text and out[3].text.split("\n")[0].startswith("d line of") and out[3].text.count("\n") == 2
    assert out[10].text == "" and out[11].text == rows[7][1]


@pytest.mark.parametrize("similar", [1.0, 0.7])
def test_lines_equal_brute_force(spark, rows, similar):
    assert same_as_brute(spark, rows, min_docs=5, similar=similar)


def test_four_templates_in_a_leaf_equal_brute_force(spark):
    """Random lines around four templates of one leaf, with repeated rows, ids and nulls."""
    rng = random.Random(3)
    heads = ["please see the " + " ".join(rng.choice("red blue green gold grey".split()) for _ in range(7)) for _ in range(4)]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(0, 3)):
            words = rng.choice(heads).split()
            for j in range(3, 10):
                if rng.random() < 0.25:
                    words[j] = rng.choice("red blue green gold grey x1 7".split())
            lines.append(" ".join(words))
        rows.append((rng.choice([i, i, i, None, 3]), "\n".join(lines) if rng.random() < 0.95 else None))
    gone = same_as_brute(spark, rows, min_docs=6, similar=0.6)
    assert len(gone) > 40


@pytest.mark.parametrize(("n", "similar", "words"), [(8, 0.7, 3), (5, 0.7, 6), (10, 0.6, 2), (4, 0.7, 9), (24, 0.7, 2), (9, 1.0, 2), (70, 0.2, 2)])
def test_large_leaves_equal_brute_force(spark, n, similar, words):
    """After one round a leaf of over 70 lines is settled by keys, exact ones, banded ones and single bands; small ones beside it are not."""
    rng = random.Random(n)
    some = [f"w{c}" for c in "abcdefghijk"[:words]]
    rows = []
    for i in range(400):
        line = " ".join(["see", "all", "of", *(rng.choice(some) if rng.random() < 0.9 else "".join(rng.choice("pqrstuv") for _ in range(9)) for _ in range(n - 3))])
        rows.append((i, "\n".join([line] * rng.randint(1, 2) + [f"but here and {rng.choice(some)} {rng.choice(some)}"])))
    rows += [(rng.randrange(400), rows[rng.randrange(100)][1]) for _ in range(100)]
    same_as_brute(spark, rows, min_docs=4, similar=similar, most_lines=0)


@pytest.mark.parametrize(("n", "similar"), [(3, 0.7), (4, 0.7), (7, 0.7), (12, 0.7), (20, 0.7), (80, 0.99), (90, 1.0), (300, 0.7), (64, 0.5)])
def test_similar_lines_share_a_key(n, similar):
    rng, depth = random.Random(n), 3
    bands, masks = line_dedup.key_masks(n, depth, similar)
    rest = max(0, n - depth)
    assert len(set(masks)) == len(masks) and (len(masks) <= 500 or bands > 62)
    cut = lambda w: [tuple(w[i * rest // bands : (i + 1) * rest // bands]) for i in range(bands)]
    keys = lambda w: {(m, tuple(b for i, b in enumerate(cut(w)) if (i == -1 - m if m < 0 else m >> i & 1))) for m in masks}
    for _ in range(30):
        x = [rng.randrange(5) for _ in range(rest)]
        off = [i for i in range(rest) if rng.random() < 2]
        rng.shuffle(off)
        y = list(x)
        for i in off[: next(k for k in range(n, -1, -1) if n - k >= similar * n)]:
            y[i] = 9
        assert keys(x) & keys(y)


def test_many_unlike_lines_of_one_leaf(spark, monkeypatch):
    """20,000 lines that share little: the rounds grow with the logarithm, not with the lines."""
    rng, kinds = random.Random(5), []
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    lines = [f"Please contact the {word()} {word()} {rng.choice(['here', 'there'])} {word()} {word()}" for _ in range(20_000)]
    lines += [f"Please contact the {word()} office for more details" for _ in range(12)]
    write = line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name, *a: (kinds.append(name), write(df, name, *a))[1])
    out = [r.n_lines_dropped for r in line_dedup.drop_recurring_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert sum(out[:20_000]) == 0 and sum(out[20_000:]) == 11
    assert kinds.count("key-heads") <= 12 and kinds.count("tried") == 1


def test_lines_of_clashing_columns_and_long_texts(spark):
    long = "\n".join(f"line of its own {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]} with words" for i in range(20_000))
    rows = [(i, long + "\n" + "the very same line here" if i < 6 else "the very same line here", 1, 2, 3, 4) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _drop int, _ROW int, _own int, N_Lines_Dropped int")
    out = {r.doc_id: r for r in line_dedup.drop_recurring_lines(df).collect()}
    assert out[0].text == rows[0][1] and out[11].text == "" and out[11].n_lines_dropped == 1 and out[5]["_ROW"] == 2 and out[5].n_lines_dropped == 1


def test_every_template_of_a_leaf_is_found(spark):
    """Five families and two frequent exact lines share one leaf; each variant has one document."""
    names = [a + b for a in "ka lo mi ne".split() for b in "dor fen gus".split()]
    ends = ["office for more details", "team by phone before noon", "desk at our main branch", "crew with any open question", "staff about your next visit"]
    lines = [f"Please contact the {n} {e}" for e in ends for n in names]
    lines += ["Please contact the one two three four five"] * 20 + ["Please contact the six seven eight nine ten"] * 20
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    out = [r.n_lines_dropped for r in line_dedup.drop_recurring_lines(df, min_docs=10).orderBy("doc_id").collect()]
    assert [sum(out[i : i + 12]) for i in range(0, 60, 12)] == [11] * 5 and sum(out[60:]) == 38


def test_leaf_with_more_templates_than_a_round_settles(spark):
    def word(i):
        return "".join("abcdefghij"[int(c)] for c in str(i))

    lines = [f"Please contact the {word(i)} {word(1000 + i)} {word(2000 + i)} {word(3000 + i)} {word(4000 + i)}" for i in range(90) for _ in range(3)]
    lines += [f"Please contact the {word(i)} office for more details" for i in range(12)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    out = [r.n_lines_dropped for r in line_dedup.drop_recurring_lines(df, min_docs=10).orderBy("doc_id").collect()]
    assert sum(out[:270]) == 0 and sum(out[270:]) == 11


def test_line_dedup_odd_tables(spark, empty):
    assert line_dedup.drop_recurring_lines(empty).count() == 0
    df = spark.createDataFrame([(1, "the same line here")] * 5 + [(None, "the same line here")], "doc_id long, text string")
    assert {r.n_lines_dropped for r in line_dedup.drop_recurring_lines(df, min_docs=3).collect()} == {0}
    assert not re.search("Python|Arrow|Pandas", plan_of(line_dedup.drop_recurring_lines(df)))


# -- pseudonyms


def luhn(s):
    total = 0
    for j, ch in enumerate(reversed(s)):
        d = int(ch)
        total += d if j % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


CASES = [
    ("card 4111111111111111 end", "card", r"card \d{16} end"),
    ("card 4111-1111-1111-1111.", "card", r"card \d{4}-\d{4}-\d{4}-\d{4}\."),
    ("on 2024-02-29, ok", "iso_date", r"on \d{4}-\d\d-\d\d, ok"),
    ("am 24.12.2023 war", "day_date", r"am \d\d\.\d\d\.\d{4} war"),
    ("id 219-09-9999 x", "ssn", r"id \d{3}-\d\d-\d{4} x"),
    ("call +1 (504) 555-2652 now", "phone", r"call \+1 \(\d{3}\) \d{3}-\d{4} now"),
    ("host 196.3.67.149 up", "ip", r"host \d+\.\d+\.\d+\.\d+ up"),
    ("iban GB82WEST12345698765432 a", "iban", r"iban GB\d\dWEST\d{14} a"),
    ("mail nt.26@mail6.example.com!", "email", r"mail u\w{12}@masked\.invalid!"),
    ('token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" z', "secret", r'token = "[0-9a-f]{40}" z'),
]
CLEAN = ["4111111111111112 fails Luhn", "2023-02-30 is no day", "300.1.1.1 no octets", "version 3.0 of 2020", "order 12345678", "000-12-3456", "GB83WEST12345698765432", "", None, "plain words only", "a-b@c"]


def test_pseudonyms(spark):
    rows = [(i, t, 1) for i, (t, _, _) in enumerate(CASES)] + [(100 + i, t, 1) for i, t in enumerate(CLEAN)] + [(50, CASES[0][0] + " " + CASES[4][0], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_pii int")
    res = pii.pseudonymize(df, "key1")
    out = {r.doc_id: r for r in res.collect()}
    for i, (text, kind, shape) in enumerate(CASES):
        assert [p.kind for p in out[i].pii] == [kind] and re.fullmatch(shape, out[i].text) and out[i].text != text, out[i]
    for i, t in enumerate(CLEAN):
        assert out[100 + i].text == t and out[100 + i].n_pii == 0
    assert luhn(re.sub(r"\D", "", out[0].text)) and out[0].pii[0].value == out[50].pii[0].value
    assert re.sub(r"\D", "", out[0].pii[0].value) == re.sub(r"\D", "", out[1].pii[0].value)  # linked across notations
    assert all(int(o) < 256 for o in out[6].pii[0].value.split("."))
    iban = out[7].pii[0].value
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    other = {r.doc_id: r.text for r in pii.pseudonymize(df, "key2").collect()}
    assert other[0] != out[0].text
    assert not re.search("Python|Arrow|Pandas", plan_of(res))
    with pytest.raises(ValueError):
        pii.pseudonymize(df, "'quote")


def test_secrets_of_any_case(spark):
    secrets = ["9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "9233a8ECf7c5B09fe5949719B6b82bc439e9329B", "AB12CDEF0123456789ABCDEF01234567"]
    rows = [(i, f"KEY = {t} end") for i, t in enumerate(secrets)] + [(9, "KEY = " + "ABCDEFGH" * 5)]
    out = {r.doc_id: r for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "key1").collect()}
    for i, t in enumerate(secrets):
        assert [p.kind for p in out[i].pii] == ["secret"] and t not in out[i].text and len(out[i].text) == len(rows[i][1])
    assert out[9].text == rows[3][1]


def test_pseudonyms_keep_the_format_that_finds_them(spark):
    """Every pseudonym is found again, as the same kind, and different values have different ones."""
    rng = random.Random(7)
    ssn = sorted({f"{rng.choice([*range(1, 666), *range(667, 900)]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" for _ in range(600)})
    bare = sorted({f"{rng.randint(2, 9)}{rng.randrange(100):02d}{rng.randint(2, 9)}{rng.randrange(10**6):06d}" for _ in range(300)})
    phone = [*bare, *(f"({b[:3]}) {b[3:6]}-{b[6:]}" for b in bare), *(f"+1 {b[:3]} {b[3:6]} {b[6:]}" for b in bare), *(f"{b[:3]}.{b[3:6]}.{b[6:]}" for b in bare), *(f"{rng.randrange(2):01d}{b[1:3]}-{b[3:6]}-{b[6:]}" for b in bare[:100])]
    secret = ["".join(rng.choice("abcdef0123456789") for _ in range(n)) + "a1" for n in (40, 126, 127, 128, 198, 700)]
    given = [(v, k) for k, vs in (("ssn", ssn), ("phone", phone), ("secret", secret)) for v in vs]
    df = spark.createDataFrame([(i, f"see {v} now") for i, (v, _) in enumerate(given)], "doc_id long, text string")
    once = pii.pseudonymize(df, "key1").select("doc_id", "text", "pii").cache()
    again = {r.doc_id: r.pii for r in pii.pseudonymize(once.select("doc_id", "text"), "key2").collect()}
    out = {}
    for r in once.collect():
        v, kind = given[r.doc_id]
        assert [p.kind for p in r.pii] == [p.kind for p in again[r.doc_id]] == [kind], (v, r.text)
        own = r.pii[0].value
        assert re.sub("[A-Za-z0-9]", "x", own) == re.sub("[A-Za-z0-9]", "x", v) and own != v
        out[v] = own
    assert len(set(out.values())) == len(out)
    last = lambda x: re.sub(r"\D", "", x)[-10:]
    assert all(len({last(out[p]) for p in phone[: 4 * len(bare)] if last(p) == b}) == 1 for b in bare)


def test_feistel_is_a_permutation(spark):
    for n in (2, 3):
        df = spark.range(10**n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("x"))
        df = df.withColumn("y", F.expr(pii.permuted("x", "k"))).withColumn("z", F.expr(pii.unpermuted("y", "k")))
        assert df.select("y").distinct().count() == 10**n and df.filter("x <> z OR length(y) <> length(x)").count() == 0


@pytest.mark.parametrize(("days", "months", "after"), [(31, 12, 0), (9, 9, 0), (31, 9, 0), (9, 12, 0), (31, 12, 12)])
def test_dates_are_permuted_in_their_notation(spark, days, months, after):
    """All dates of a block of years that a notation can show, and only those, come out once each."""
    df = spark.sql("SELECT explode(sequence(DATE '1800-01-01', DATE '1999-12-31')) AS d").filter(f"day(d) <= {days} AND day(d) > {after} AND month(d) <= {months}")
    out = df.select("d", F.expr(pii.permuted_date("d", str(days), str(months), "k", after)).alias("z")).selectExpr("d", "make_date(z.y, z.m, z.d) AS e", "z")
    assert out.filter(f"z.d > {days} OR z.d <= {after} OR z.m > {months} OR year(e) NOT BETWEEN 1800 AND 1999").count() == 0
    assert out.select("e").distinct().count() == df.count() > 1000 and out.filter("d = e").count() < 50


def test_notations_and_clashing_columns(spark):
    cases = [r"due 3/4/2020 ok", "due 12/25/2020 ok", "due 31.12.9999 ok", "call +14155552671 ok", "call 5555551234 ok", "due 5.11.1999 ok"]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(cases)] * 2, "doc_id long, TEXT string, _matches int, _New int, m int")
    res = pii.pseudonymize(df, "k1")
    assert res.columns == ["doc_id", "TEXT", "_matches", "_New", "m", "pii", "n_pii"]
    out = {r.doc_id: r.TEXT for r in res.collect()}
    assert res.count() == 12 and all(re.sub(r"\d", "9", out[i]) == re.sub(r"\d", "9", t) and out[i] != t for i, t in enumerate(cases))
    month, day, _ = map(int, out[1].split()[1].split("/"))
    assert 12 < day < 32 and 0 < month < 13 and out[3].startswith("call +1")


def test_long_texts_of_pii(spark):
    text = "word and 4111111111111111 or nt@mail.example.com more\n" * 4000
    row = pii.pseudonymize(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k1").first()
    assert row.n_pii == 8000 and len({p.value for p in row.pii}) == 2 and "4111111111111111" not in row.text


def test_pii_empty(spark, empty):
    assert pii.pseudonymize(empty, "k1").count() == 0


# -- chat


def test_rotation(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", "héllo <|end|>"), (1, 3, "ann", None), (2, 0, "bob", "alone"), (3, 0, "system", "nobody"), (1, 1, "ann", "hi"), (4, None, None, "x"), (None, 0, "ann", "y")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, window string")
    res = chat.rotate(df)
    out = {(r.conv_id, r.participant): r for r in res.collect()}
    assert set(out) == {(1, "ann"), (1, "bob"), (2, "bob"), (4, "unknown"), (None, "ann")}
    ann = out[1, "ann"]
    assert ann.text == "<|system|>\nrules<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\nhéllo < |end|><|end|>\n<|assistant|>\n<|end|>\n"
    assert [ann.text[m.start : m.end] for m in ann.mask] == ["hi<|end|>", "<|end|>"] and (ann.n_messages, ann.n_trained) == (4, 2)
    bob = out[1, "bob"]
    assert [bob.text[m.start : m.end] for m in bob.mask] == ["héllo < |end|><|end|>"]
    assert [m.role for m in bob.messages] == ["system", "user", "assistant", "user"]
    assert not re.search("Python|Arrow|Pandas", plan_of(res))


def test_long_dialogues_are_cut(spark):
    df = spark.range(1000).selectExpr("7L AS conv_id", "id AS turn", "concat('p', id % 3) AS role", "'t' AS text")
    out = chat.rotate(df, window=50)
    assert out.count() == 20 * 3 and out.agg(F.max("n_messages")).first()[0] == 50 and out.agg(F.sum("n_trained")).first()[0] == 1000
    ties = spark.range(120).selectExpr("7L AS conv_id", "0L AS turn", "'p' AS role", "concat('t', id) AS text")
    assert sorted(r.n_messages for r in chat.rotate(ties, window=50).collect()) == [20, 50, 50]
    assert chat.rotate(df.limit(0)).count() == 0


def test_windows_keep_participants_and_opening(spark):
    """71 turns: the third speaker speaks only in the second window; both windows open with the rules."""
    rows = [(1, 0, "system", "rules"), (1, 1, "system", "more rules")] + [(1, i, "ab"[i % 2], f"t{i}") for i in range(2, 70)] + [(1, 70, "system", "late"), (1, 71, "c", "end")]
    df = spark.createDataFrame(rows + [(None, *r[1:]) for r in rows], "conv_id long, turn long, role string, text string")
    out = {(r.conv_id, r.window, r.participant): r for r in chat.rotate(df).collect()}
    assert set(out) == {(c, w, p) for c in (1, None) for w in (0, 1) for p in "abc"}
    assert out[1, 0, "c"].n_trained == 0 and out[1, 0, "c"].n_messages == 64
    for p in "abc":
        m = [(x.role, x.content) for x in out[1, 1, p].messages]
        assert m[:2] == [("system", "rules"), ("system", "more rules")] and ("system", "late") in m[2:] and len(m) == 10
    assert [out[1, 1, "c"].text[x.start : x.end] for x in out[1, 1, "c"].mask] == ["end<|end|>"]


def test_long_dialogues_equal_their_oracle(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, *range(200)]), rng.choice(["system", "a", "b", None]), rng.choice(["x", "yy", None, "<|z"])) for _ in range(700)]
    rows += [(3, i, "system" if i < 3 else "ab"[i % 2], f"t{i}") for i in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(tmp_path / "conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    want = con.execute(queries.ORACLE_SQL["op8_chat"]).fetchall()
    got = queries.op8_chat(spark, str(tmp_path)).collect()
    key = lambda r: tuple((x is None, x) for x in r[:4])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
