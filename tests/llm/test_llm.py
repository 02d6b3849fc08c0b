"""The operators on language-model data against brute force, exact merges, planted cases and held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import leaks, mixing, nearest, pii, pii_labels, sketch


@pytest.mark.parametrize("tick", [None, 3, 7, 50])
def test_nearest(spark, tick):
    rng = random.Random(1)
    pick = lambda n: rng.choice([None, *range(n)])
    quotes = [(f"q{i}", rng.choice([" A", "a", "B ", None]), pick(300)) for i in range(120)]
    trades = [(f"t{i}", rng.choice(["A", "b", None]), pick(300)) for i in range(90)] + [(None, "A", 3)]
    plain = F.upper(F.trim("k"))
    left, right = (spark.createDataFrame(r + r[:9], "id string, k string, us long").withColumn("_t", F.lit("clash")) for r in (trades, quotes))
    ask = dict(entity=plain, left_id="id", left_us=F.col("us"), right_id="qid", right_us=F.col("us"), tolerance_us=10, tick_us=tick)
    got = {tuple(r) for r in nearest.nearest(left, right.withColumnRenamed("id", "qid"), **ask).collect()}
    want = set()
    for t, k, us in trades:
        near = [(abs(qus - us), qus, q) for q, qk, qus in quotes if None not in (t, k, us, qk, qus) and qk.strip().upper() == k.strip().upper() and abs(qus - us) <= 10]
        if near:
            want.add((t, min(near)[2], min(near)[1] - us))
    assert got == want
    assert nearest.nearest(left.limit(0), right.withColumnRenamed("id", "qid").limit(0), **ask).collect() == []


@pytest.mark.parametrize("shape", [sketch.Dyadic(), sketch.Dyadic(bits=14, width=128)])
@pytest.mark.parametrize("most", [None, 100])
def test_sketch(spark, shape, most):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(8, 2, 20_000), -rng.lognormal(3, 1, 3_000), np.zeros(500)])
    rows = [("a", float(v), i % 3) for i, v in enumerate(values)] + [("b", 5.0, 0), ("b", None, 0), ("b", float("nan"), 0), (None, 1.0, 0)]
    df = spark.createDataFrame(rows, "k string, v double, part int").withColumn("_large", F.lit("clash"))
    wanted = {f"p{p}": p / 100 for p in (1, 10, 25, 50, 75, 90, 99)}
    ask = dict(shape=shape, most=most)
    whole = sketch.build(df, ["k"], "v", **ask).cache()
    parts = [sketch.build(df.where(F.col("part") == i), ["k"], "v", **ask) for i in range(3)]
    assert {tuple(r) for r in sketch.merge(*parts, **ask).collect()} == {tuple(r) for r in whole.collect()}
    assert whole.groupBy("k").count().agg(F.max("count")).first()[0] <= shape.cells
    got = {r.k: r for r in sketch.percentiles(whole, wanted, shape).collect()}
    assert set(got) == {"a", "b"} and got["a"].n == len(values) and got["b"].p50 == pytest.approx(5, rel=0.01)
    assert got["b"].rank_error == 0 and (most is None or 0 < got["a"].rank_error < 0.1)
    ordered = np.sort(values)
    for name, p in wanted.items():
        v, slack = getattr(got["a"], name), got["a"].value_error * 1.000001
        low, high = (np.searchsorted(ordered, v - s * slack * (1 + abs(v)), side) / len(values) for s, side in ((1, "left"), (-1, "right")))
        assert low - got["a"].rank_error <= p <= high + got["a"].rank_error + 1e-4
    # deletions leave the sketch of what remains, whether its codes were kept or not
    minus = sketch.build(df.where("part > 0"), ["k"], "v", weight=F.lit(-1), **ask)
    gone, first = sketch.merge(whole, minus, shape=shape, most=0), sketch.merge(parts[0], shape=shape, most=0)
    assert {tuple(r) for r in gone.collect()} == {tuple(r) for r in first.collect()}
    assert sketch.percentiles(sketch.build(df.limit(0), ["k"], "v", **ask), wanted, shape).collect() == []
    whole.unpersist()


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau the of and that any such".split()) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, rng.randrange(45, 120)))) for i in range(25)] + [(99, "too short"), (98, None)]
    docs, want = [], set()
    for d in range(120):
        body = words(rng, rng.randrange(0, 400))
        if d % 3:
            i = rng.randrange(25)
            part = items[i][1].split()
            begin = rng.randrange(0, len(part) - 32)
            part = part[begin : begin + rng.randrange(32, 70)]
            edited = rng.sample(range(len(part)), len(part) // 9) if d % 2 else []
            part = [w for j, w in enumerate(part) if j not in edited or rng.random() < 0.7]
            for j in edited:
                if j < len(part):
                    part[j] = part[j][::-1] + "q"
            part = [w.upper() if rng.random() < 0.2 else w for w in part]
            part[len(part) // 2] += "\n\nKC 12/20 – Page 4\n\n(7)"
            part[3] = part[3][:2] + "-\n" + part[3][2:] if len(part[3]) > 4 else part[3]
            at = rng.randrange(len(body) + 1)
            body[at:at] = part
        elif d % 9 == 0:  # shorter common wording is no case
            body[5:5] = items[d % 25][1].split()[:22]
        docs.append((d, " ".join(body)))
    docs += [(500, None), (501, ""), docs[1]]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_text", F.lit(1))
    passages = spark.createDataFrame(items, "item_id long, passage string")
    ask = dict(doc_id="doc_id", text="text", item_id="item_id", passage="passage")
    got = [tuple(r) for r in leaks.leaked(frame, passages, **ask).collect()]
    # brute force: every document aligned with every item
    search = leaks.Search(items[:25], leaks.Plan(), leaks.FURNITURE)
    texts = [(d, np.array(search.words.of(t, search.furniture))) for d, t in docs[:120] if t]
    pairs = [(i, d, w, search.items[i]) for d, w in texts for i in range(25)]
    for k in range(0, len(pairs), 500):
        some = pairs[k : k + 500]
        quick = leaks.holds([x[2] for x in some], [x[3] for x in some], leaks.Plan())
        want |= {(i, d) for (i, d, w, item), ok in zip(some, quick) if ok or (search._enough(w, item) and leaks.holds_exactly(w, item, leaks.Plan()))}
    assert len(got) == len(set(got)) and set(got) <= want and len(want) > 60
    print("recall", len(set(got)) / len(want), len(want))
    assert len(set(got)) >= 0.95 * len(want)
    blocked = leaks.leaked(frame, passages, plan=leaks.Plan(items_a_block=10), **ask)
    assert {tuple(r) for r in blocked.collect()} == set(got)
    assert leaks.leaked(frame.limit(0), passages, **ask).collect() == [] and leaks.leaked(frame, passages.limit(0), **ask).collect() == []


def test_alignment_against_brute_force():
    """holds() and holds_exactly() against every pair of an item's stretch and a document's, by edit distance."""
    rng, plan = random.Random(6), leaks.Plan(least=8, one_in=4)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(60):
        item = [rng.randrange(9) for _ in range(12)]
        doc = [rng.randrange(9) for _ in range(4)] + [w if rng.random() > rng.choice([0.05, 0.4]) else 77 for w in item] + [rng.randrange(9) for _ in range(3)]
        brute = any(
            distance(item[a:b], doc[c:e]) * 4 <= b - a for a in range(5) for b in range(a + 8, 13) for c in range(len(doc)) for e in range(c + 5, min(len(doc), c + 16) + 1)
        )
        fast = bool(leaks.holds([np.array(doc)], [np.array(item)], plan)[0])
        assert brute or not fast
        assert leaks.holds_exactly(np.array(doc), np.array(item), plan) == brute


def test_mix(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice([" Big", "BIG ", "big", "big", "small", "mid", None, "unlisted"]), rng.choice([0, 5, 50, 500])) for i in range(3000)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, tokens long").withColumn("position", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("Small", 0.3, 4), ("mid", 0.15, 2), ("gone", 0.05, 3)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(sized, targets, doc_id="doc_id", source="source", schedules={"small": ((0, 0.0), (0.5, 2.0), (1, 1.0))}, buckets=8).cache()
    rows, shares = mixed.collect(), {r.source: r for r in mixing.shares(mixed, targets).collect()}
    for s, t in (("big", 0.5), ("small", 0.3), ("mid", 0.15)):
        assert shares[s].reached_share == pytest.approx(t / 0.95, abs=0.01) and shares[s].most_repeats <= shares[s].max_repeats
        assert shares[s].tokens == sum(r.tokens for r in rows if r.source == s)
    assert shares["gone"].tokens == 0 and shares["gone"].reached_share == 0
    assert all(0 <= r.progress <= 1 for r in rows) and len({(r.doc_id, r["copy"]) for r in rows}) == len(rows)
    # the schedule's integral up to 0.5 is 0.5 of 1.25
    early = sum(r.tokens for r in rows if r.source == "small" and r.progress < 0.5) / shares["small"].tokens
    assert early == pytest.approx(0.4, abs=0.03)
    positions = [r.position for r in mixed.toLocalIterator()]
    assert positions == sorted(positions)
    # a unit of position is a token, wherever it lies: what comes before a position sums to it
    total, done = sum(r.tokens for r in rows), 0
    for r in sorted(rows, key=lambda r: r.position):
        done += r.tokens
        assert abs(done - r.position) <= 0.02 * total
    assert mixing.mix(sized.limit(0), targets, doc_id="doc_id", source="source").collect() == []
    with pytest.raises(ValueError):
        mixing.mix(sized, targets, doc_id="doc_id", source="source", total=10**9)


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello hello world"), (2, ""), (3, None), (4, "<|endoftext|>" + "x " * 50_000)], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in mixing.token_counts(df, doc_id="doc_id", text="text").collect()}
    assert got[1] == 3 and got[2] == got[3] == 0 and got[4] > 50_000


#: Sentence forms that the labelled table does not have, with the mention in braces.
UNSEEN = [
    ("Passport {533380006} expired in March.", "id_number"),
    ("Judge {Hedvika Ornwick} delivered a dissent.", "person_name"),
    ("Der Vermieter {Klaus Bergmann} kündigte fristlos.", "person_name"),
    ("Send the papers to {lena.roth@kanzlei-nord.example} before Friday.", "email"),
    ("You can reach her on {+44 20 7946 0018} in the evening.", "phone"),
    ("The couple moved into {14 Brewer Street}, Leeds, last autumn.", "street_address"),
    ("Meine Adresse lautet {Goethestraße 12a}, Bonn.", "street_address"),
    ("Il demeure au {27 bis rue des Acacias}, à Lyon.", "street_address"),
    ("According to the log, {Miriam K. Feldt} left at noon.", "person_name"),
    ("La locataire, {Odile Marchand}, n'a rien payé.", "person_name"),
    ("Sa ligne fixe, le {01 42 68 53 00}, ne répondait plus.", "phone"),
    ("Bitte rufen Sie {030 54321 678} zurück.", "phone"),
    ("Her insurance number, {QQ 12 34 56 C}, was copied wrongly.", "id_number"),
    ("Die Steuer-ID {12 345 678 901} fehlte im Antrag.", "id_number"),
    ("Le numéro {1 85 05 78 006 084 36} figure sur la carte.", "id_number"),
    ("Counsel for the bank, {T. Ashgrove}, conceded the point.", "person_name"),
    ("We thank {Jonas Wexler} for the translation.", "person_name"),
    ("Contact: {p.novak [at] mailbox [dot] example}", "email"),
    ("Ses courriels partaient de {c.duval@poste.example} chaque soir.", "email"),
    ("Die Mutter, {Renate Holzinger}, bestätigte das.", "person_name"),
    ("the late {GEORGE WHITLOCK} owned the mill", "person_name"),
    ("Nobody at {8 Fennel Court} had seen the van.", "street_address"),
    ("Le gérant {Bruno Castel} a fermé la boutique.", "person_name"),
    ("Mechanic {Pat O'Hara} repaired the brakes.", "person_name"),
    ("Unterlagen gingen an {m.krause@amt.example} per Eilpost.", "email"),
    ("Dial {0161 496 0123} for the duty officer.", "phone"),
    ("Wir trafen {Frieda Lohmann} am Bahnhof.", "person_name"),
    ("Son passeport, {09AB12345}, était périmé.", "id_number"),
    ("The deliveries went to {3C Tanner's Row} every week.", "street_address"),
    ("Auf dem Klingelschild {Am Wehr 7} stand kein Name.", "street_address"),
]


GIVEN = ("Clovis", "Zelda", "Ottilka", "Emeric")


@pytest.fixture(scope="module")
def model():
    return pii.train(GIVEN)


def test_tagger_on_unseen_forms(model):
    """The table's own names are in GIVEN; nothing else of these sentences is in the table."""
    tagger, hits, found = pii.Tagger(model), 0, 0
    for text, kind in UNSEEN:
        mention = text[text.index("{") + 1 : text.index("}")]
        got = set(tagger.mentions([text.replace("{", "").replace("}", "")])[0])
        hits, found = hits + ((kind, "".join(c for c in mention if c.isalnum()).lower()) in got), found + len(got)
    print("unseen forms", hits, found, len(UNSEEN))
    assert hits >= 0.6 * len(UNSEEN) and hits >= 0.8 * found


def test_tagger_on_held_out_fillings(model):
    tagger, hits, wanted, found = pii.Tagger(model), 0, 0, 0
    for pieces in pii_labels.labelled(list(GIVEN), copies=2, seed=99):
        text = "".join(t for t, _ in pieces)
        want = {(label, "".join(c for c in t if c.isalnum()).lower()) for t, label in pieces if label}
        got = set(tagger.mentions([text])[0])
        hits, wanted, found = hits + len(want & got), wanted + len(want), found + len(got)
    assert hits / wanted > 0.85 and hits / found > 0.93


def test_texts_are_decoded_alike_alone_and_together(model):
    texts = ["".join(t for t, _ in p) for p in pii_labels.labelled(list(GIVEN), copies=1, seed=7)]
    tagger = pii.Tagger(model)
    together = tagger.mentions([*texts, "", " ".join(texts)])
    assert together[: len(texts)] == [tagger.mentions([t])[0] for t in texts] and together[len(texts)] == []


def test_redaction(spark, model):
    text = "Before Zelda Marrath, presiding\n\n1. Papers were sent to zelda.m@post.test. Tel. 020 7946 0018\n\n2. The lease stood."
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "the lease stood " * 20_000), (1, text)], "doc_id long, text string").withColumn("_doc", F.lit(1))
    names = spark.createDataFrame([(g,) for g in (*GIVEN, None)], "given_name string")
    out = {r.doc_id: r for r in pii.redact(docs, names).collect()}
    assert out[1].text == "Before [PERSON_NAME], presiding\n\n1. Papers were sent to [EMAIL]. Tel. [PHONE]\n\n2. The lease stood."
    assert (out[2].text, out[3].text, out[4].mentions) == ("", None, 0)
    found = {(r.pii_type, r.pii_key) for r in pii.find(docs, names).collect()}
    assert found == {("person_name", "zeldamarrath"), ("email", "zeldamposttest"), ("phone", "02079460018")}
    assert pii.find(docs.limit(0), names).collect() == []
