"""Tokens, pieces, packing, repeats, Jaccard join, LM scores: against brute force and the libraries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from carelake.llm import jaccard, lm, packing, pieces, repeats, tokens

ODD = [" ", "  ", "a", "é", "\n", "\t", "the", " of", "　", "'s", "1", "!", "<s>", "</s>", "▁", "\r", " b", "x" * 70, "日本", "aaaa",
       "\U0001F600", "<0x41>", "<|endoftext|>", "\x85", "\x1c"]


def odd_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 30))) for _ in range(n)]


def as_bytes(ids):
    return np.array(ids, "<u4").tobytes()


def frame(sp, texts, start=0):
    """Documents with ids from ``start`` and columns whose names an operator uses inside."""
    return sp.createDataFrame([(start + i, t, 1, "x", 2) for i, t in enumerate(texts)],
                              "doc_id long, text string, length int, cls string, id int")


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    texts = [*odd_texts(4000), "", "word " * 400_000, "x" * 10]
    want = [as_bytes(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]
    encoder = tokens.Encoder(tokens.tokenizer_path())
    assert list(encoder.encode(texts)) == want
    assert list(encoder.encode(texts)) == want  # from the cache


def test_tokens_are_kept_in_little_memory():
    import gc
    import tracemalloc

    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(150_000)]
    texts = [" ".join(words[at: at + 1000]) for at in range(0, len(words), 1000)]
    encoder = tokens.Encoder(tokens.tokenizer_path())
    list(encoder.encode(texts[:1]))
    gc.collect()
    tracemalloc.start()
    try:
        list(encoder.encode(texts))
        gc.collect()
        kept = sum(x.size for x in tracemalloc.take_snapshot().statistics("filename")) - encoder.rolling.up.nbytes - encoder.rolling.down.nbytes
    finally:
        tracemalloc.stop()
    assert len(encoder.young) > 140_000
    assert kept < 60 * len(encoder.young)


def test_tokens_survive_the_turn_of_generations():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    encoder = tokens.Encoder(tokens.tokenizer_path())
    encoder.most = 20
    for turn in range(12):
        texts = [*odd_texts(30, turn % 4), " the word comes again", f" number{turn} " + "y" * 70]
        assert list(encoder.encode(texts)) == [as_bytes(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]
        assert len(np.unique(encoder.young.keys)) == len(encoder.young) == len(encoder.young.begin) == len(encoder.young.sizes)
        assert (np.diff(encoder.young.keys.astype(object)) > 0).all()
    assert len(encoder.old)


def test_a_task_gives_memory_back_before_and_after(monkeypatch):
    from carelake.llm import common

    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append("back"))

    def run(batches):
        for x in batches:
            seen.append(x)
            yield x

    assert list(common.giving_back(run)(iter([1, 2]))) == [1, 2]
    assert seen == ["back", 1, 2, "back"]
    part = common.giving_back(run)(iter([3, 4]))
    assert next(part) == 3
    part.close()  # a task that is ended early
    assert seen[4:] == ["back", 3, "back"]


def test_pieces_equal_the_library_and_come_back(sp):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    encoder = pieces.PieceEncoder(pieces.model_path())
    texts = [*odd_texts(4000), "word " * 300_000, "ab" * 3000]
    found = list(encoder.encode(texts))
    assert found == [as_bytes(x) for x in library.encode(texts, num_threads=1)]
    plain = [t for t in texts if "▁" not in t]
    assert [encoder.decode(x) for x, t in zip(found, texts) if "▁" not in t] == plain
    rows = pieces.decode(pieces.encode(frame(sp, [None, "", "  two  spaces ", "é<s>\n"]))).collect()
    want = {0: "", 1: "", 2: "  two  spaces ", 3: "é<s>\n"}
    assert {r["doc_id"]: r["text"] for r in rows} == want
    both = pieces.round_trip(frame(sp, [None, "", "  two  spaces ", "é<s>\n"])).collect()
    assert {r["doc_id"]: r["text"] for r in both} == want
    assert [r["n_ids"] for r in sorted(both)] == [len(library.encode(want[i])) for i in range(4)]


def test_viterbi_fold_finds_the_best_path():
    with open(pieces.model_path(), "rb") as f:
        model = pieces.Model(f.read())
    model.kind = pieces.Model.UNIGRAM
    encoder = pieces.PieceEncoder.from_model(model)
    score = {model.pieces[i].decode(): model.scores[i] for i in encoder.ids}

    def best(word):
        top = [0.0] + [-math.inf] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(max(0, e - encoder.longest), e):
                piece = word[s:e]
                value = score.get(piece, encoder.unknown if e - s == 1 else -math.inf)
                top[e] = max(top[e], top[s] + value)
        return top[-1]

    for word in ("▁the", "▁interesting", "▁naïve", "▁日本", "▁xqz"):
        ids = np.frombuffer(encoder._segment([word.encode()])[0], "<u4")
        total = sum(model.scores[i] for i in ids if model.kinds[i] != pieces.Model.BYTE)
        unknown = sum(1 for c in word if c not in score)
        assert total + unknown * encoder.unknown == pytest.approx(best(word))


def test_packing(sp):
    r = random.Random(2)
    texts = [None, "", "a", *(" ".join(r.choice("ab cd ef gh ij".split()) for _ in range(r.choice([5, 40, 90, 300]))) for _ in range(120))]
    capacity = 64
    rows = packing.pack(frame(sp, texts + texts[-3:]), capacity).toPandas()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    for i, text in enumerate(texts + texts[-3:]):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        own = rows[rows["doc_id"] == i].sort_values("piece")
        assert own["piece"].tolist() == list(range(len(own)))
        assert own["start"].tolist() == np.r_[0, own["length"].cumsum()[:-1]].astype(int).tolist()
        assert own["length"].sum() == len(ids) and (own["length"][1:] == capacity).all()
        for s, n, crc in zip(own["start"], own["length"], own["ids_crc32"]):
            assert zlib.crc32(as_bytes(ids[s: s + n])) == crc
    placed = rows.sort_values(["sequence_id", "offset"])
    ends = placed["offset"] + placed["length"]
    assert (placed["offset"] == ends.groupby(placed["sequence_id"]).shift(fill_value=0)).all() and ends.max() <= capacity
    assert rows["sequence_id"].nunique() <= -(-rows["length"].sum() // capacity) * 1.05 + 1
    assert packing.pack(frame(sp, texts).where("false"), capacity).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plans_place_every_piece_once(seed):
    r = random.Random(seed)
    histogram = {r.randint(1, 256): r.randint(1, 500) for _ in range(80)}
    for trial in packing.TRIALS:
        bins = packing.plan(histogram, 256, *trial)
        found = Counter()
        for n, items in bins:
            assert n > 0 and sum(items) <= 256
            for x in items:
                found[x] += n
        assert found == histogram


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(0)
    for trial in range(30):
        n, width = rng.integers(1, 30), rng.integers(1, 60)
        rows = rng.integers(0, 2 + trial % 3, (n, width)).astype(np.uint8)
        if n > 3:
            rows[1] = rows[0]
        place, prefix = repeats.row_order(rows)
        order = np.argsort(place)
        text = [rows[i].tobytes() for i in order]
        assert text == sorted(text)
        for i in range(1, n):
            same = next((k for k in range(width) if text[i][k] != text[i - 1][k]), None)
            assert prefix[i] >= width if same is None else prefix[i] == same


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i: i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        step = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i: i + length]] > 1:
                step[i] += 1
                step[i + length] -= 1
        gone = np.cumsum(step)[:-1] > 0
        out.append((len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()),
                    bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("length,most_group", [(12, 4096), (12, 1), (40, 3)])
def test_repeats(sp, length, most_group):
    """Also with groups over the limit, which are counted string by string."""
    r = random.Random(3)
    base = ["".join(r.choice("abcé \n") for _ in range(r.randint(0, 200))) for _ in range(12)]
    texts = [None, "", "short", "a" * 300, "ab" * 100]
    for _ in range(60):
        t = list(r.choice(base))
        for _ in range(r.randint(0, 6)):
            if t:
                t[r.randrange(len(t))] = r.choice("xyz")
        texts.append("".join(t) + (r.choice(base)[:50] if r.random() < 0.5 else ""))
    texts += texts[-3:]
    rows = repeats.remove_repeats(frame(sp, texts), length, most_group=most_group).collect()
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in rows}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, length)


@pytest.mark.parametrize("chunk", [50_000, 40])
def test_a_common_passage_costs_one_row_a_chunk(sp, monkeypatch, chunk):
    """900 documents with one passage: its segments are handed on once a chunk with all places, and the passage goes everywhere."""
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    seen = {}
    written = repeats.written
    monkeypatch.setattr(repeats, "written", lambda df, name: seen.setdefault(name, written(df, name)))
    r = random.Random(8)
    passage = "".join(r.choice("abcdefgh ") for _ in range(120))
    texts = ["".join(r.choice("uvwxyz ") for _ in range(r.randint(0, 30))) + "<" + passage + f">{i}" for i in range(900)]
    rows = repeats.remove_repeats(frame(sp, texts).repartition(3), 40).collect()
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in rows}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 40)
    segments = seen["segments"].groupBy("f", "h", "n", "a").agg({"c": "sum", "*": "count"}).where("`sum(c)` = 900").collect()
    assert segments and len({x["chunk"] for x in seen["segments"].select("chunk").collect()}) == (3 if chunk > 1000 else max(x["count(1)"] for x in segments))
    assert max(x["count(1)"] for x in segments) < 900 / 4


def brute_components(rows):
    sets, up, lists, shared = {}, {}, defaultdict(list), Counter()

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[i] = {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        up[i] = i
        for x in sets[i]:
            lists[x].append(i)
    for ids in lists.values():
        for a in range(len(ids)):
            for b in range(a):
                shared[ids[b], ids[a]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("most_list,chunk", [(256, 1024), (3, 20)])
def test_jaccard_components(sp, most_list, chunk):
    """Copies, near copies and a shared passage; also with every list long and clusters of many chunks."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    make = lambda n: [r.choice(words) for _ in range(n)]
    passage, base = make(40), [make(r.randint(20, 150)) for _ in range(10)]
    rows = [(0, None), (1, ""), (2, "a b"), (3, "A  b"), (4, "a b c d e"), (5, " \n")]
    for i in range(6, 200):
        b = list(base[0] if i < 90 else r.choice(base))
        for _ in range(r.randint(0, 5)):
            b[r.randrange(len(b))] = r.choice(words)
        if r.random() < 0.3:
            b = make(r.randint(10, 60)) + passage
        rows.append((i, " ".join(b)))
    found = jaccard.jaccard_components(frame(sp, [t for _, t in rows]), most_list=most_list, chunk=chunk).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found} == brute_components(rows)


def test_jaccard_pairs_are_given_once(sp):
    """However many shingles and hash partitions two near copies share, their pair is made about once."""
    r = random.Random(8)
    rows = []
    for _ in range(50):
        base = [f"w{r.randrange(10 ** 6)}" for _ in range(300)]
        for _ in range(4):
            copy = list(base)
            for _ in range(3):
                copy[r.randrange(300)] = "x"
            rows.append(" ".join(copy))
    texts = frame(sp, rows).selectExpr("doc_id AS id", "text")
    made = []
    for bits in (5, 8):
        postings = jaccard._shared_postings(texts, np.zeros(1 << 20, np.uint8), bits, 5, 75, 64)
        known, met = jaccard._meetings(postings, bits, 75)
        met = [tuple(x) for x in met.collect()]
        assert known.count() == 200 and len(set(met)) == 50 * 6
        made.append(len(met))
    assert max(made) <= 1.2 * 50 * 6
    # by count in each partition they would be these
    keys = {x["cls"]: set(np.frombuffer(x["keys"], np.uint64) >> np.uint64(56)) for x in known.collect()}
    assert sum(len(keys[a] & keys[b]) for a, b in set(met)) > 20 * 50 * 6


def test_jaccard_passages_make_no_cluster_in_a_crowded_table(sp, monkeypatch):
    """Passages that many documents share are told from rare shingles also where many shingles share a slot, as in a large table."""
    monkeypatch.setattr(jaccard, "LEAST_SLOT_BITS", 12)
    monkeypatch.setattr(jaccard, "MOST_SLOT_BITS", 12)
    r = random.Random(11)
    word = lambda: f"w{r.randrange(10 ** 6)}"
    passages = [[word() for _ in range(30)] for _ in range(24)]
    texts = [[word() for _ in range(170)] for _ in range(2000)]
    for p in passages:
        for i in r.sample(range(2000), 90):
            texts[i] = texts[i][:80] + p + texts[i][80:]
    texts += [[*t[:-1], "x"] for t in texts[:50]]
    rows = frame(sp, [" ".join(t) for t in texts]).selectExpr("doc_id AS id", "text")
    table, levels, bits = jaccard._levels(rows, 5)
    pairs, stars = jaccard._candidates(rows, levels, bits, 5, 75, 64)
    assert stars.count() == 0  # before, nearly all that have a passage were one cluster
    found = jaccard.jaccard_components(frame(sp, [" ".join(t) for t in texts])).collect()
    assert {x["doc_id"]: x["component_id"] for x in found} == {i: i if i < 2000 else i - 2000 for i in range(2050)}


def test_ranked_levels():
    counts = np.random.default_rng(3).poisson(350, 1 << 14)
    counts[:400] += 65
    level = jaccard.ranked(np.split(counts, 64))
    assert np.argsort(np.argsort(level, kind="stable"))[:400].min() > len(counts) // 3
    assert (np.diff(level[np.argsort(counts, kind="stable")].astype(int)) >= 0).all()
    assert jaccard.ranked([np.zeros(8, np.int64)] * 3).tolist() == [0] * 24
    few = jaccard.ranked([np.array([0, 0, 1, 0]), np.array([0, 2, 9, 5000])])
    assert (few[[0, 1, 3, 4]] == few[0]).all() and few[0] < few[2] < few[5] < few[6] < few[7]


def test_divide_skip_equals_counting():
    r = np.random.default_rng(4)
    sets = [np.unique(r.choice(200, r.integers(20, 120))).astype(np.uint64) for _ in range(60)]
    sets += [np.unique(np.r_[sets[0], [900 + i]]).astype(np.uint64) for i in range(40)]
    index = jaccard.Index(sets)
    for i, q in enumerate(sets):
        want = [j for j, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 75 * len(np.union1d(q, s))]
        assert index.search(q).tolist() == want


def test_lm_scores(sp):
    r = random.Random(6)
    texts = [None, "", " \n", "One", *(" ".join(r.choice("a b c D e".split()) for _ in range(r.randint(1, 30))) for _ in range(40))]
    texts += texts[-2:]
    split = [(t or "").lower().split() for t in texts]
    one, two = Counter(w for s in split for w in s), Counter(p for s in split for p in zip(s, s[1:]))
    total = sum(map(len, split))
    for blocks in ("file", "hashed"):
        df = frame(sp, texts)
        if blocks == "file":
            import tempfile

            path = tempfile.mkdtemp() + "/docs"
            df.write.parquet(path)
            df = sp.read.parquet(path)
        got = {x["doc_id"]: x for x in lm.score(df).collect()}
        for i, s in enumerate(split):
            own1, own2 = Counter(s), Counter(zip(s, s[1:]))
            want = 0.0
            for k, w in enumerate(s):
                short = math.log(max(one[w] - own1[w], 1) / max(total - len(s), 1))
                if k:
                    pair = (s[k - 1], w)
                    left = two[pair] - own2[pair]
                    want += math.log(left / max(one[s[k - 1]] - own1[s[k - 1]], 1)) if left > 0 else math.log(0.4) + short
                else:
                    want += short
            assert got[i]["n_tokens"] == len(s)
            assert got[i]["log_score"] == pytest.approx(want, abs=1e-9)
            assert (got[i]["mean_log"] is None) == (not s)


@pytest.mark.parametrize("run", [lambda d: repeats.remove_repeats(d), lambda d: jaccard.jaccard_components(d), lambda d: lm.score(d),
                                 lambda d: pieces.decode(pieces.encode(d))])
def test_empty_table(sp, run):
    assert run(frame(sp, ["x"]).where("false")).count() == 0
