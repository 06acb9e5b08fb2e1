import hashlib
import random
import re
import zlib

import pytest

from faultlens.llm import language_id, media, pii, quality_rules

from .helpers import SCHEMA, edge_docs, edge_rows, words


def ordered(rows):
    return sorted(rows, key=repr)


def brute_quality(text):
    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if words(x)]
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    repeated = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts_match_brute_force(spark):
    got = quality_rules.quality_rules(edge_docs(spark)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert ordered((r["doc_id"], *(r[n] for n in names)) for r in got) == ordered((r[0], *brute_quality(r[1])) for r in edge_rows())
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_boilerplate_lines_deplete_documents(spark):
    """Documents are counted, so a text copied often on one host is boilerplate there; repeated rows of one document are not."""
    r = random.Random(2)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    common, copied = text(30), text(40)
    rows = [(d, f"{text(200 if d % 2 else 5)}\n{common.upper() if d % 3 else common}", None, "h", None) for d in range(60)]
    rows += [(100 + d, copied, None, "h", None) for d in range(50)] + [(300, text(40), None, "h", None)] * 50 + [(200 + d, f"{text(5)}\n{common}", None, None, None) for d in range(5)]
    got = {x["doc_id"]: x for x in quality_rules.quality_rules(edge_docs(spark, rows)).collect()}
    assert all(got[d]["kept"] == bool(d % 2) and got[d]["n_line_words"] == 30 for d in range(60))
    assert not any(got[100 + d]["kept"] for d in range(50)) and got[300]["kept"] and all(got[200 + d]["kept"] for d in range(5))


def test_language_needs_letters_and_learns_from_few_rows(spark):
    de, en = "der und die nicht ein schön wird auch", "the and with that from this which"
    r = random.Random(4)
    rows = [(d, " ".join(r.choice((de if d % 2 else en).split()) for _ in range(40)), "de" if d % 2 else "en", None, None) for d in range(200)]
    rows += [(300, None, "en", None, None), (301, "", "en", None, None), (302, "123 ... \n", "de", None, None), (None, en, "en", None, None), (303, "шум", None, None, None), (304, en, None, None, None), (304, en, None, None, None)]
    got = language_id.language_id(edge_docs(spark, rows)).collect()
    by = {x["doc_id"]: x for x in got}
    assert len(got) == len(rows)
    assert all(x["lang_pred"] == ("de" if x["doc_id"] % 2 else "en") for x in got if x["doc_id"] is not None and x["doc_id"] < 200)
    assert [by[k]["lang_pred"] for k in (300, 301, 302)] == ["und"] * 3 and by[303]["lang_pred"] in ("de", "en") and by[304]["lang_pred"] == "en"
    assert all(0 <= x["score"] <= 1 for x in got)
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in got if x["doc_id"] is not None)
    kept = language_id.known_languages(edge_docs(spark, rows))
    assert kept.count() == len(rows) - 3 and kept.where("lang IS NULL").count() == 0 and kept.where("cid = 'clash'").count() == len(rows) - 3


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language_id.language_id(docs).where("held_out").join(docs, "doc_id").select("lang", "lang_pred").collect()
    assert len(got) > 20 and sum(r[0] == r[1] for r in got) >= 0.97 * len(got)


def test_language_families_are_one_versus_one_inside():
    assert language_id.family_of("de") == language_id.family_of("en") != language_id.family_of("fr") == language_id.family_of("es")
    assert language_id.family_of("xx") == "xx"


@pytest.mark.parametrize("operator", [quality_rules.quality_rules, language_id.language_id, pii.personal_data])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []


def test_base_spans_follow_the_patterns():
    text = "a@b.co x.y@z.example.org. 1.2.3.4 1.2.3.999 10.0.0.1.5 4111 1111 1111 1111 4111-1111-1111-1112 +1 (736) 555-2678 +12 34 é@x.fr @b.c a@b 0000.1.1.1"
    found = [(pii.KINDS[k], text[s:e]) for s, k, e in pii.base_spans(text)]
    assert found == [
        ("email", "a@b.co"), ("email", "x.y@z.example.org"), ("ip", "1.2.3.4"), ("ip", "10.0.0.1"), ("phone", "+1 (736) 555-2678"), ("ip", "0000.1.1.1"),
    ]
    r = random.Random(1)
    for _ in range(20_000):
        t = "".join(r.choice("ab1.@-%+_ é") for _ in range(r.randint(1, 18)))
        assert [m.span() for m in pii.EMAIL.finditer(t)] == [m.span() for m in pii.emails(t)]
        t = "".join(r.choice("0123.. a") for _ in range(r.randint(1, 24)))
        assert [m.span() for m in pii.IP.finditer(t)] == [m.span() for m in pii.IP_ONCE.finditer(t)]
        assert [m.group() for m in pii.NODE.finditer(t)] == [w for w in words(t) if any(c.isdigit() or c == "@" for c in w)]


def brute_spans(text):
    """Base spans by the contract's patterns alone."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for k, (kind, pattern) in enumerate(plain.items()):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            luhn = sum(d if j % 2 == 0 else (2 * d) // 10 + (2 * d) % 10 for j, d in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else None, "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_base_spans_of_a_whole_table_match_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = random.Random(8)
    odd = [(10**6 + k, "".join(r.choice("0123456789 -.+()@ax") for _ in range(60)), None, None, None) for k in range(400)]
    odd += [(2 * 10**6 + k, f"x {r.choice(['4111 1111 1111 1111', '4111-1111-1111-1112', '1.2.3.4.5', '+49 (30) 1234.5678', '+1-2', '300.1.1.1', '0000004.1.1.1'])}{r.choice(['', '.', '1', ' 2'])}", None, None, None) for k in range(100)]
    rows = [*docs.select("doc_id", "text").collect(), *odd, (None, None, None, None, None)]
    spark.createDataFrame([(x[0], x[1], None, None, None) for x in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.query(spark, str(tmp_path)).collect()
    want = []
    for d, t, *_ in rows:
        spans = brute_spans(t)
        want.append((d, *(sum(x.startswith(k) for x in spans) for k in pii.KINDS), hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert ordered(tuple(x)[:6] for x in got) == ordered(want)
    by = {x["doc_id"]: x["spans"].split(",") for x in got}
    assert all(set(brute_spans(t)) <= set(by[d]) for d, t, *_ in rows if t and d is not None and brute_spans(t))


def test_planted_repeats_of_observed_words_are_found(spark):
    """Local numbers that repeat a whole phone number are found, repeats of whole addresses are base spans, and little else is added.

    The part of an address before its @ is no node of the field, and isn't labelled.
    """
    r, rows, planted = random.Random(12), [], {}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(150).collect()
    for d in range(150):
        words_, local, name = (docs[d][0] or "").split(" ")[:200], f"{r.randint(200, 999)}-{r.randint(1000, 9999)}", f"jo.{r.choice('abcdef')}{r.randint(10, 99)}"
        full = [f"+1 ({r.randint(200, 999)}) {local}", f"{name}@mail{r.randint(1, 9)}.example.com"]
        head, text = " ".join(words_), ""
        text = f"{head} call {full[0]} or write {full[1]} now. "
        if d % 2:
            planted[d] = []
            for w in (local, name):
                text += " ".join(r.choice(words_ or ["x"]) for _ in range(30)) + " "
                planted[d].append((len(text), len(text) + len(w)))
                text += w + " "
        rows.append((d, text, None, None, None))
    got = {x["doc_id"]: {tuple(map(int, s.split(":")[1:])) for s in x["spans"].split(",") if s} - {tuple(map(int, s.split(":")[1:])) for s in x["base"].split(",") if s} for x in pii.personal_data(spark.createDataFrame(rows, SCHEMA)).collect()}
    numbers, names = (sum(ps[k] in got[d] for d, ps in planted.items()) for k in (0, 1))
    assert numbers >= 0.9 * len(planted) and names == 0
    assert sum(len(v) for d, v in got.items()) - numbers <= 0.05 * len(rows)


def test_messages_on_loops_are_near_the_exact_marginals():
    """Brute force over all labellings of small graphs with loops, whose skip edges are as strong as learned ones."""
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(5)
    k = len(pii.LABELS)
    for text in ("555-2678 555-2678 555-2678", "+1 (736) 555-2678 then 555-2678 555-2678", "a@b.co 12 a@b.co 12"):
        field = pii.Field(text, pii.base_spans(text))
        model = pii.Model(rng.normal(0, 0.3, (pii.SHAPES, k)), np.eye(k) * 0.4, np.eye(k) * 0.8)
        node = model.weights[field.features].sum(1)
        want = np.zeros((field.n, k))
        for labels in product(range(k), repeat=field.n):
            if all(o < 0 or o == y for o, y in zip(field.observed, labels, strict=True)):
                s = sum(node[i, y] for i, y in enumerate(labels) if field.observed[i] < 0)
                s += sum(0.4 * (labels[i] == labels[j]) for i, j in field.chain) + sum(0.8 * (labels[i] == labels[j]) for i, j in field.skip)
                want[np.arange(field.n), labels] += np.exp(s)
        want /= want.sum(1, keepdims=True)
        got = model.marginals(field)
        assert len(field.skip) and np.abs(got - want).max() < 0.08 and (got.argmax(1) == want.argmax(1)).all()


def test_a_sample_without_ids_is_bounded(spark):
    """Rows whose ids are null or equal are drawn by their texts."""
    rows = [(None if d % 2 else 7, f"call +1 (736) 555-{d:04} {'x' * (d % 9)} {d}", None, None, None) for d in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    counts = []
    real, pii.fit = pii.fit, lambda r, n: counts.append(n.sum()) or real(r, n, steps=2)
    try:
        pii.learn(docs, "doc_id", "text", 100)
    finally:
        pii.fit = real
    assert 0 < counts[0] < 0.5 * 400 * 5


def test_dirty_languages_are_bounded(spark, monkeypatch):
    """Thousands of values of a language column: the most frequent are learned."""
    monkeypatch.setattr(language_id, "MOST", 2)
    rows = [(d, f"the and {d}" if d % 2 else f"der die {d}", ("en" if d % 2 else "de") if d % 4 < 2 else f"junk{d}", None, None) for d in range(400)]
    model = language_id.learn(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "lang", 500)
    assert model.langs == ["de", "en"]


def test_predictions_follow_the_learned_weights(spark):
    """Every prediction again, position by position and pair by pair, from the model's weights."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.learn(docs, "doc_id", "text", "lang", 200)
    rows = [(d["doc_id"], d["text"]) for d in docs.select("doc_id", "text").limit(60).collect()] + [(-1, "123"), (-2, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("text", "doc_id")
    got = {r["doc_id"]: (r["p"], r["s"]) for r in language_id.judged(frame, model, 1, ("p", "s")).collect()}
    for d, text in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        if not any(c.isalpha() for c in text or ""):
            assert got[d] == ("und", 0.0)
            continue
        margin = np.array([np.mean([sum(model.weights[f[i], k] for f in language_id.features(raw)) for i in range(len(raw))]) + model.bias[k] for k in range(len(model.pairs))]) if len(raw) < 400 else None
        if margin is None:
            continue

        def winner(group, names, margin=margin):
            wins = dict.fromkeys(names, 0.0)
            for (g, a, b), m in zip(model.pairs, margin, strict=True):
                if g == group:
                    sure = 1 / (1 + np.exp(-2 * m))
                    wins[a] += (m >= 0) + 1e-3 * sure
                    wins[b] += (m < 0) + 1e-3 * (1 - sure)
            return max(names, key=lambda x: wins[x])

        family = winner(None, model.families)
        assert got[d][0] == winner(family, model.members[family])


def test_no_document_changes_what_another_one_gets():
    import numpy as np

    r = random.Random(3)
    k = len(pii.LABELS)
    rng = np.random.default_rng(3)
    model = pii.Model(rng.normal(size=(pii.SHAPES, k)), *(lambda x: (x[0] + x[0].T, x[1] + x[1].T))(rng.normal(size=(2, k, k))))
    texts = [" ".join(r.choice(["+1 (736) 555-2678", "555-2678", "12", "a@b.co", "a", "w", "7365552678"]) for _ in range(r.randint(0, 60))) for _ in range(40)]
    fields = [pii.Field(t, pii.base_spans(t)) for t in texts]
    for f, p in zip(fields, model.all_marginals(fields), strict=True):
        assert np.array_equal(p, model.marginals(f))


@pytest.mark.parametrize("text", ["1" * 400_000, "x" * 400_000 + " 1", "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "1 " * 100_000, "a.b-" * 100_000 + "@", "call +1 (736) 555-2678 or 555-2678 " * 10_000])
def test_long_odd_texts_take_linear_time(text):
    import time

    import numpy as np

    start = time.process_time()
    spans = pii.base_spans(text)
    field = pii.Field(text, spans)
    k = len(pii.LABELS)
    model = pii.Model(np.zeros((pii.SHAPES, k)), np.eye(k), 2 * np.eye(k))
    pii.added_spans(field, model.marginals(field), spans)
    assert time.process_time() - start < 20


def test_the_field_adds_what_repeats_an_observed_word(spark):
    text = "call +1 (736) 555-2678 today " + "word " * 400 + "or 7365552678 again, not 20231105 of 12 things\nmail jo.doe9@x.example.org or just jo.doe9 there"
    rows = [(1, text, None, None, None), (2, "plain words only", None, None, None), (3, None, None, None, None), (4, "a@b.co\nx 5 y", None, None, None), (None, "a@b.co", None, None, None), (4, "a@b.co\nx 5 y", None, None, None)]
    got = {x["doc_id"]: x for x in pii.personal_data(edge_docs(spark, rows)).collect()}
    spans = [s.split(":") for s in got[1]["spans"].split(",")]
    assert {text[int(s):int(e)] for _, s, e in spans} >= {"+1 (736) 555-2678", "jo.doe9@x.example.org"}
    assert set(got[1]["base"].split(",")) <= set(got[1]["spans"].split(","))
    assert not any("20231105" in text[int(s):int(e)] for _, s, e in spans)
    assert [int(s) for _, s, _ in spans] == sorted(int(s) for _, s, _ in spans)
    assert got[2]["spans"] == got[3]["spans"] == "" and got[4]["spans"] == "email:0:6" and got[None]["n_email"] == 1


def test_messages_carry_observations_over_skip_edges():
    import numpy as np

    k = len(pii.LABELS)
    weights = np.zeros((pii.SHAPES, k))
    weights[pii.number_of("bias")] = np.log([0.6, 0.1, 0.1, 0.1, 0.1])
    model = pii.Model(weights, np.zeros((k, k)), 4 * np.eye(k))
    text = "x 5551234 " + "w " * 50 + "5551234 and 99"
    f = pii.Field(text, [(2, 3, 9)])
    p = model.marginals(f)
    exact = 0.1 * np.exp(4) / (0.1 * np.exp(4) + 0.9)  # one edge: messages are exact
    assert abs(p[1, 4] - exact) < 1e-3 and p[2].argmax() == 0


def test_an_observed_number_reaches_all_its_repeats():
    import numpy as np

    k = len(pii.LABELS)
    weights = np.zeros((pii.SHAPES, k))
    weights[pii.number_of("bias"), 0] = 1.0
    skip = 9 * np.eye(k)
    skip[0, 0] = 0
    text = "call +1 (736) 555-2678 " + "or so 555-2678 " * 60
    base = pii.base_spans(text)
    f = pii.Field(text, base)
    spans = pii.added_spans(f, pii.Model(weights, np.zeros((k, k)), skip).marginals(f), base)
    assert [text[s:e] for s, _, e in spans] == ["555-2678"] * 60 and {kind for _, kind, _ in spans} == {3}


def test_media_round_trip(spark, tmp_path):
    index, folder = media.store_media(edge_docs(spark), folder=f"file://{tmp_path}/media")
    rows = media.media_features(media.media_metadata(index, folder), folder).collect()
    want = []
    for d, t, *_ in edge_rows():
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        image = media.to_png(payload)
        assert media.from_png(image) == payload
        want.append((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest()))
    assert ordered(tuple(r)[:7] for r in rows) == ordered(want)
    assert len({(r["payload_sha256"], r["feature"]) for r in rows}) == len({r["payload_sha256"] for r in rows})


def test_media_shards_are_tar_files_with_each_payload_once(spark, tmp_path):
    import tarfile

    rows = [(d, f"text {d % 4}", None, None, None) for d in range(40)]
    index, _ = media.store_media(edge_docs(spark, rows).coalesce(1), folder=f"file://{tmp_path}/m")
    shards = list((tmp_path / "m").iterdir())
    members = [m for s in shards for m in tarfile.open(s).getmembers()]
    assert len(members) == 4 and all(m.name.endswith(".png") for m in members)
    heads = media.media_metadata(index, f"file://{tmp_path}/m").collect()
    assert {(r["width"], r["height"], r["bits"], r["colour"]) for r in heads} == {(192, 1, 8, 0)}


def test_media_of_nothing(spark):
    index, folder = media.store_media(spark.createDataFrame([], SCHEMA))
    assert media.media_features(media.media_metadata(index, folder), folder).collect() == []
