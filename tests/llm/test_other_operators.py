"""Chat, vectors, pages, quality, components, the pipeline and the registered queries."""

import html as entities
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from carelake.llm import ann, chat, common, html, near_vectors, quality, queries
from carelake.llm.components import components
from oracle_compare import compare, duck

SF_SMALL, SF_ORACLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_registered():
    names = [n for n in E.queries() if re.match(r"op\d+_|pipeline$", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_oracle(sp, name):
    problems, _, _ = compare(sp, duck(SF_SMALL), name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF_SMALL)
    assert not problems, problems


def test_chat_examples(sp):
    hard = "</s>[INST] \\ [/INST] <s>\\["
    rows = [(1, 0, "system", "be"), (1, 1, "user", hard), (1, 2, "assistant", hard), (1, 3, "user", None), (1, 4, "assistant", ""),
            (1, 5, "user", "end"), (2, 0, "user", "only"), (None, 0, None, "x"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a")]
    df = sp.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    out = chat.format_chat(df)
    examples = out.orderBy("conv_id", "example").collect()
    assert [(r["conv_id"], r["example"]) for r in examples] == [(None, 0), (1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (3, 1)]
    for r in examples:  # only the turn marks hold control strings
        assert r["text"].count("</s>") == r["text"].count("<s>") == r["text"].count("[INST]") == r["text"].count("[/INST]")
    assert examples[1]["text"][examples[1]["loss_start"]: examples[1]["loss_end"]].replace("<\\", "<").replace("[\\", "[").replace("\\\\", "\\") == hard
    got = {r["conv_id"]: r for r in chat.digest(out).collect()}
    assert {k: (v["n_turns"], v["loss_chars"]) for k, v in got.items()} == {None: (1, 0), 1: (6, len(hard)), 2: (1, 0), 3: (2, 2)}
    assert chat.digest(chat.format_chat(df.where("false"))).count() == 0


def vectors(sp, seed, n=600, d=16):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    x[n // 3: n // 2] = x[0] + 0.05 * r.normal(size=(n // 2 - n // 3, d))
    x[5:8] = x[4]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(n, None), (n + 1, [0.0] * d), (n + 2, [float("nan")] * d), (n + 3, [None] + [1.0] * (d - 1)), (n + 4, [1.0]), (n + 5, [float("inf")] * d)]
    return x, sp.createDataFrame(rows + bad + rows[:2], "vec_id long, embedding array<double>").withColumn("leaf", F.lit(1))


def test_ann_recall_and_scores(sp):
    x, df = vectors(sp, 1)
    x = x * np.linspace(0.5, 2, len(x))[:, None]
    df = sp.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, 10).toPandas()
    hits = 0
    for q, rows in got.groupby("query_id"):
        rows = rows.sort_values("rank")
        scores = x @ x[q]
        scores[q] = -np.inf
        assert rows["rank"].tolist() == list(range(1, 11))
        assert np.allclose(scores[rows["vec_id"]], rows["score"], rtol=0, atol=1e-12)
        assert (np.diff(rows["score"]) <= 0).all()
        hits += len(set(rows["vec_id"]) & set(np.argsort(-scores)[:10]))
    assert got["query_id"].nunique() == 30 and hits / 300 >= 0.9


def test_ann_leaves_out_unusable_vectors(sp):
    _, df = vectors(sp, 2, 120)
    got = ann.search(df, F.col("vec_id") % 20 == 0, 20).toPandas()
    assert got["vec_id"].max() < 120 and not got.duplicated(["query_id", "vec_id"]).any()
    few = ann.search(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0, 20).toPandas()
    assert sorted(few["vec_id"]) == [1, 2]
    assert ann.search(df.where("false"), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("most", [1024, 40])
def test_near_vectors(sp, monkeypatch, most):
    """Against all pairs; also with every list cut into many blocks."""
    monkeypatch.setattr(near_vectors, "MOST_MEMBERS", most)
    monkeypatch.setattr(near_vectors, "MOST_PROBERS", most)
    x, df = vectors(sp, 3)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    while True:
        new = np.array([min(root[i], root[link[i]].min(initial=root[i])) for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    got = near_vectors.near_vectors(df).toPandas().set_index("vec_id").sort_index()
    assert len(got) == 606
    assert got["n_links"][:600].tolist() == link.sum(1).tolist() and got["component_id"][:600].tolist() == root.tolist()
    assert (got["n_links"][600:] == 0).all() and got["kept"][600:].all()
    assert near_vectors.near_vectors(df.where("false")).count() == 0


def test_near_vectors_in_many_lists(sp, monkeypatch):
    """All links of a group of near copies that fills many lists, and of pairs across lists, against all pairs."""
    monkeypatch.setattr(near_vectors, "LIST_ROWS", 16)
    r = np.random.default_rng(4)
    n, d = 2400, 32
    x = r.normal(size=(n, d))
    x[:800] = x[0] / np.linalg.norm(x[0]) + 0.29 / np.sqrt(d) * r.normal(size=(800, d))
    x[800:1200] = x[1200:1600] + 0.4 * r.normal(size=(400, d))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum(1) - 1
    got = near_vectors.near_vectors(sp.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    assert want[:800].sum() > 300_000 and want[800:].sum() > 400
    assert got.toPandas().set_index("vec_id").sort_index()["n_links"].tolist() == want.tolist()


def test_coded_products_take_the_place_of_table_look_ups():
    """The distance to a coded vector, by one product, is within the coding error of the true one."""
    r = np.random.default_rng(6)
    x = r.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    quantiser = near_vectors.Quantiser(x[:4000], len(x))
    lists = near_vectors.nearest(x, quantiser.centres, 1)[:, 0]
    codes, missed = quantiser.encode(x, lists)
    coded = quantiser.coded(codes, lists)
    assert np.allclose(np.linalg.norm(x - coded, axis=1), missed)
    far = np.sqrt(near_vectors.squared(x[:500], coded))
    true = np.sqrt(near_vectors.squared(x[:500], x))
    assert (np.abs(far - true) <= missed + 1e-6).all()
    single = coded.astype(np.float32) @ x[:500].T.astype(np.float32)
    assert np.abs(single - coded @ x[:500].T).max() < near_vectors.SINGLE / 10


def test_near_vectors_send_few_rows_to_blocks(sp, monkeypatch):
    """Evenly scattered vectors: a vector meets each block once, not each list or table, and all links are found."""
    sent = []
    blocks = near_vectors.blocks

    def counted(members, probers, *rest):
        sent.append(probers.count())
        return blocks(members, probers, *rest)

    monkeypatch.setattr(near_vectors, "blocks", counted)
    r = np.random.default_rng(9)
    n, d = 6000, 48
    x = r.normal(size=(n, d))
    x[:300] = x[300:600] + 0.3 * r.normal(size=(300, d))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    got = near_vectors.near_vectors(sp.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    assert got.toPandas().set_index("vec_id").sort_index()["n_links"].tolist() == ((u @ u.T >= 0.9).sum(1) - 1).tolist()
    assert sent[0] <= 2.5 * n


def test_near_vectors_meet_in_rounds(sp, monkeypatch):
    """What is sent to the blocks at a time is in proportion to the table, however many blocks each vector meets."""
    for name, value in (("MOST_MEMBERS", 400), ("MOST_PROBERS", 400), ("WIDEST", 1), ("ROUND_BYTES", 0), ("MOST_HELD", 1), ("MOST_HITS", 500)):
        monkeypatch.setattr(near_vectors, name, value, raising=False)
    sent = []
    blocks = near_vectors.blocks

    def counted(members, probers, *rest):
        sent.append(probers.count())
        return blocks(members, probers, *rest)

    monkeypatch.setattr(near_vectors, "blocks", counted)
    r = np.random.default_rng(12)
    n, d = 1500, 24
    x = r.normal(size=(n, d))
    x[:400] = x[0] / np.linalg.norm(x[0]) + 0.25 / np.sqrt(d) * r.normal(size=(400, d))  # a list with shelves of its own
    x[400:500] = x[500:600]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    got = near_vectors.near_vectors(sp.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    got = got.toPandas().set_index("vec_id").sort_index()
    assert got["n_links"].tolist() == link.sum(1).tolist()
    root = np.arange(n)
    while (new := np.array([min(root[i], root[link[i]].min(initial=root[i])) for i in range(n)])).tolist() != root.tolist():
        root = new
    assert got["component_id"].tolist() == root.tolist()
    assert max(sent) <= 1.25 * n < sum(sent)


def test_written_tables_leave_no_shuffle_files(sp):
    """What a query shuffled goes when its table is written; a table goes when it is forgotten."""
    disk = sp._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: len(re.findall(r"shuffle_\d+_\d+_\d+[.]data", disk.getAllFiles().mkString(" ")))
    sp._jvm.System.gc()
    table, before = common.written(sp.range(20_000).selectExpr("id % 7000 AS k").groupBy("k").count(), "t"), shuffles()
    for _ in range(3):
        table = common.written(table.selectExpr("k % 900 AS k").groupBy("k").count(), "t")
    until = time.time() + 20
    while shuffles() > before and time.time() < until:
        time.sleep(0.2)
    assert shuffles() <= before and table.count() == 900
    assert sp.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    path = table.written_to.removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(path)
    common.forget(table)
    assert not os.path.exists(path)


def test_components(sp):
    r = random.Random(8)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(0, i) for i in range(400, 450)] + [(7, 7), (None, 3)]
    up = {i: i for i in range(450)}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        if a is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = components(sp.createDataFrame(links, "a long, b long")).collect()
    linked = {i for a, b in links if a is not None and a != b for i in (a, b)}
    assert {x["node"]: x["component"] for x in got} == {i: root(i) for i in linked}


def test_pages(sp):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "plain <b>text"), (4, "u", "<nav><a href='/'>x</a></nav>")]
    pages = sp.read.parquet(f"{SF_ORACLE}/pages.parquet")
    model = html.fit(pages)
    got = {r["page_id"]: r for r in html.extract(sp.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert [got[i]["text"] for i in (1, 2, 4)] == ["", "", ""]

    def want(page):
        inside = re.search("<article>(.*)</article>", page, re.S).group(1)
        parts = re.split("</?(?:p|h1|div|ul|li)[^>]*>", inside)
        return "\n".join(x for x in (" ".join(entities.unescape(re.sub("<[^>]+>", "", y)).split()) for y in parts) if x)

    for r in html.extract(pages, model).join(pages.select("page_id", "html"), "page_id").collect():
        assert r["text"] == want(r["html"]) and r["n_chars"] == len(r["text"])


def test_block_reader():
    blocks = html.read_blocks('<div class="post-body">a <b>b</b><br>c<p>x &amp; y<p>z<script>var a="<p>";</script>tail <a href="x">l</a> <im')
    assert [(b.text, b.path, b.linked) for b in blocks] == [
        ("a b c", ("div", "post", "body"), 0), ("x & y", ("div", "post", "body", "p"), 0), ("ztail l", ("div", "post", "body", "p"), 1)]


def test_self_closed_icons(sp):
    """A self-closed svg drops nothing after it; one with an end tag goes up to that; a slash in a value closes nothing."""
    assert [b.text for b in html.read_blocks('<p>a<svg/>b<svg class="i" />c<SVG a=\'x=y\'/>d<svg>e</svg>f<svg w=1/>g</svg>h<p>i<script/>j')] == ["abcdfh", "i"]
    pages = sp.read.parquet(f"{SF_ORACLE}/pages.parquet")
    icons = pages.withColumn("html", F.regexp_replace("html", "(<nav[^>]*>|<h1[^>]*>|<p>)", "$1<svg class=\"icon\" viewBox=\"0 0 9 9\"/>"))
    assert icons.where("html like '%<svg%'").count() == pages.count()
    model = html.fit(pages)
    rows = [{r["page_id"]: r["text"] for r in html.extract(p, model).collect()} for p in (pages, icons)]
    assert rows[0] == rows[1]


# names that no list holds, and none
OTHER = {"article": "texte", "nav": "leiste", "aside": "rand", "footer": "fuss", "header": "kopf", "main": "mitte", "section": "teil"}


def relaid(page, named):
    for tag, name in OTHER.items():
        page = re.sub(rf"<{tag}\b[^>]*>", f'<div class="{name}">', page).replace(f"</{tag}>", "</div>")
    return re.sub(r'class="ad"', 'class="qzv"', page) if named else re.sub(r'\s(class|id|role)="[^"]*"', "", page)


@pytest.mark.parametrize("named,least", [(True, 0.9), (False, 0.8)])
def test_pages_of_unknown_layouts(sp, named, least):
    """Pages whose parts have other names, or none, give the words of their articles; the model has not seen these pages."""
    pages = sp.read.parquet(f"{SF_ORACLE}/pages.parquet")
    model = html.fit(pages.where("page_id % 2 = 0"))
    rows = [(r["page_id"], "u", r["html"]) for r in pages.where("page_id % 2 = 1").collect()]
    want = {r["page_id"]: r["text"] for r in html.extract(sp.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    other = sp.createDataFrame([(i, u, relaid(h, named)) for i, u, h in rows], "page_id long, url string, html string")
    hit = found = wanted = 0
    for r in html.extract(other, model).collect():
        got, due = Counter(r["text"].split()), Counter(want[r["page_id"]].split())
        assert r["text"] and due
        hit, found, wanted = hit + sum((got & due).values()), found + sum(got.values()), wanted + sum(due.values())
    assert 2 * hit / (found + wanted) >= least


def test_bounded_blocks_train(sp, monkeypatch):
    """Pages that don't fit what is left of the blocks don't train; the others do, whole."""
    seen = []
    monkeypatch.setattr(html.Network, "train", lambda self, pages: seen.extend(pages))
    rows = [(i, "<div class='menu'>" + "<p>x</p>" * n + "</div>") for i, n in enumerate([30, 5000, 40])]
    html.fit(sp.createDataFrame(rows, "page_id long, html string"), most_blocks=100)
    assert sorted(len(labels) for _, labels in seen) == [30, 40]


def test_all_blocks_of_long_pages_train(sp, monkeypatch):
    seen = []
    monkeypatch.setattr(html.Network, "train", lambda self, pages: seen.extend(pages))
    page = "<div class='menu'>" + "<p>x</p>" * 450 + "</div>"
    html.fit(sp.createDataFrame([(1, page), (2, page + page)], "page_id long, html string"))
    assert sorted(len(labels) for _, labels in seen) == [50, 100, 400, 400, 400]
    seen.clear()
    html.fit(sp.createDataFrame([(1, page + "<article>" + "<p>y</p>" * 30 + "</article>")], "page_id long, html string"))
    assert sum(labels[-30:].sum() for _, labels in seen) >= 30 and sum(len(labels) for _, labels in seen) > 480
    assert max(len(labels) for _, labels in seen) <= html.LONGEST


def test_quality(sp):
    docs, labels = (sp.read.parquet(f"{SF_ORACLE}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs.withColumn("score", F.lit(3)), labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    held = got[got["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert (held["predicted"] == held["quality"]).mean() >= 0.95
    odd = sp.createDataFrame([(1, None), (2, ""), (None, "x " * 200_000), (3, " \n")], "doc_id long, text string")
    assert quality.score(odd, quality.fit(docs, labels)).where("score between 0 and 1").count() == 4
    assert quality.classify(odd, labels.where("false")).where("score = 0.5").count() == 4
    assert quality.classify(odd.where("false"), labels).count() == 0


def test_context_vectors_cover_all_documents(sp):
    """Against counting word by word; most documents have no label."""
    r = random.Random(9)
    texts = [None, "", "One", *(" ".join(r.choice("a b c D e".split()) + str(i % 9) for _ in range(r.randint(1, 40))) for i in range(60))]
    docs = sp.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = quality.fit(docs, sp.createDataFrame([(i, i % 2) for i in range(3, 12)], "doc_id long, quality long"))
    index, want = quality.index_vectors(quality.WORDS, 1), np.zeros((quality.WORDS, quality.DIM))
    for t in texts:
        words = [c // quality.SHAPES for codes in quality.Coder().codes(t or "") for c in codes]
        for i, w in enumerate(words):
            for j in range(max(0, i - quality.REACH), min(len(words), i + quality.REACH + 1)):
                if j != i:
                    want[w] += index[words[j]]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.count_nonzero(np.abs(want).sum(1)) == 45 and np.allclose(model.context, want, atol=1e-5)


def test_word_codes(monkeypatch):
    """Words by their lower-cased bytes, shapes by kinds with runs shortened; blocks don't change them."""
    coder = quality.Coder()
    codes = lambda t: [c for part in coder.codes(t) for c in part.tolist()]
    text = "Thanks!!! thanks!! THANKS \t a1b22 a9b77  été\nx" + "y" * 300 + " " + "z" * 70_000 + " end"
    found = codes(text)
    assert len(found) == len(text.split()) and [codes(w)[0] for w in text.split()] == found
    word, kind = ([f(c) for c in found] for f in (lambda c: c // quality.SHAPES, lambda c: c % quality.SHAPES))
    assert codes("Thanks")[0] // quality.SHAPES == codes("thanks")[0] // quality.SHAPES == word[2] != word[0]
    assert kind[3] == kind[4] and word[3] != word[4] and kind[0] != kind[1]
    assert codes("Aaaa!!!!")[0] % quality.SHAPES == kind[0] and kind[6] == kind[7] == kind[8]
    monkeypatch.setattr(quality, "BLOCK_BYTES", 16)
    assert codes(text) == found and codes("") == codes(" \n") == []


def test_held_out_labels_are_not_read(sp):
    docs, labels = (sp.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.classify(docs, x).orderBy("doc_id").toPandas() for x in (labels, turned))
    assert np.allclose(a["score"], b["score"], atol=1e-9)


def test_pipeline_stages(sp):
    """Every stage on its own input; filters against their operators' brute force in the other tests."""
    docs = sp.read.parquet(f"{SF_SMALL}/documents.parquet")
    extra = sp.createDataFrame([(10_000, None, "en", "s", 0), (10_001, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(extra).withColumn("kept", F.lit(1))
    columns = list(corpus_pipeline.COLUMNS)
    good = corpus_pipeline.quality_stage(sp, docs, SF_SMALL)
    assert good.columns == columns
    near = corpus_pipeline.near_duplicate_stage(sp, docs, SF_SMALL)
    from test_text_operators import brute_components, brute_repeats
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"]: r["text"] for r in near.collect()}
    assert near.columns == columns and set(kept) == {i for i, (_, c) in brute_components(list(rows.items())).items() if i == c}
    cut = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.repeats_stage(sp, docs, SF_SMALL).collect()}
    sizes = {r["doc_id"]: r["n_chars"] for r in docs.collect()}
    for (i, text), (_, removed, _, left) in zip(rows.items(), brute_repeats(rows.values(), 400)):
        want = left.decode("utf-8", "ignore")
        assert cut[i] == ((want, len(want)) if removed else (text, sizes[i]))
    packed = corpus_pipeline.packing_stage(sp, docs, SF_SMALL)
    assert packed.select("doc_id").distinct().count() == len(rows)


def test_pipeline_on_an_empty_table(sp):
    docs = sp.read.parquet(f"{SF_SMALL}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(sp, docs, SF_SMALL).count() == 0


def test_near_duplicates_among_rows_of_one_id(sp):
    """Unlike rows of one id stay, like ones leave one; null ids stay; the smallest id of a group stays."""
    text = lambda k: " ".join(f"{k}word{i}" for i in range(40))
    rows = [(5, text("a")), (5, text("b")), (5, text("a") + " end"), (3, text("b")), (9, text("c")), (9, text("c")), (None, text("a")), (None, text("a")),
            (5, None), ((1 << 60) + 1, text("d")), ((1 << 60) + 3, text("d"))]
    docs = sp.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_duplicate_stage(sp, docs, SF_SMALL)
    got = sorted(((r["doc_id"], (r["text"] or "")[:5]) for r in kept.collect()), key=repr)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    assert got == sorted([(5, "aword"), (3, "bword"), (9, "cword"), (None, "aword"), (None, "aword"), (5, ""), ((1 << 60) + 1, "dword")], key=repr)
