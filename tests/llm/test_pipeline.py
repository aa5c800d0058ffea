import re
from collections import Counter

import pytest

from maskwright.llm import minhash, mixing, packing, pii_boost, quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def stages(spark, documents, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), documents, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{folder}/{i}")
        out.append((docs, spark.read.parquet(f"{folder}/{i}")))
        docs = out[-1][1]
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(stages):
    assert len(stages) == 5
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_rejected_documents_go(stages):
    before, after = stages[0]
    assert ids(after) == ids(quality.judged(before).filter("kept"))


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    assert ids(after) == ids(minhash.near_duplicates(before).filter("kept"))


def test_personal_data_is_gone(stages):
    before, after = stages[2]
    assert ids(after) == ids(before)
    assert pii_boost.found(after).filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
    assert all(r.n_chars == len(r.text) for r in after.collect())
    spans = {r.doc_id: r.spans for r in pii_boost.found(before).collect()}
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        if not spans[r.doc_id]:
            assert r.text == texts[r.doc_id]
        else:
            assert re.search("<(EMAIL|IP|CARD|PHONE|SSN|SECRET)>", r.text)


def test_the_mix_repeats_documents(stages):
    before, after = stages[3]
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix_digest(before).collect() if r.size}
    counts = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert counts == {d: n for d, n in taken.items() if n}


def test_sequences_hold_everything(stages):
    before, after = stages[4]
    whole = packing.pack_documents(before)
    assert whole.count() == after.count() and whole.agg({"length": "sum"}).first()[0] == after.agg({"length": "sum"}).first()[0]


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, DATA).count() == stages[-1][1].count()


ROWS = [
    (1, None, "en", None, 0, 7), (2, "", None, "a", None, 7), (3, "short", "en", "a", 5, 7), (4, "x" * 300_000, "en", "a", 300_000, 7),
    (None, "no id " + " ".join(f"w{k}" for k in range(80)), "en", None, 1, 7), (None, "no id " + " ".join(f"w{k}" for k in range(80)), "en", None, 1, 7),
    *[(5, " ".join(f"v{k}" for k in range(90)) + " write to ab@c.de", "en", "b", 400, 7)] * 3,
    (6, " ".join(f"v{k}" for k in range(90)) + " write to ab@c.de now", "de", "c", 400, 7),
    (7, " ".join(f"u{k}" for k in range(30_000)), "fr", "c", 1, 7), (7, " ".join(f"t{k}" for k in range(60)), "fr", "d", 1, 7),
    *[(20 + k, " ".join(f"s{k}x{j}" for j in range(55 + k)), "en", "hot", 1, 7) for k in range(30)],
]


def test_every_stage_takes_awkward_rows(spark, tmp_path):
    """Null, empty, repeated and very long rows, ids that are missing or shared, and columns
    named as the stages name theirs; then the same with no rows at all."""
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint, `row` int, shard int, kept_id int, spans string, base string, size string, label string"
    wide = [(*r, 1, 2, "s", "b", "z", "l") for r in ROWS]
    for rows, folder in ((wide, "some"), ([], "none")):
        docs, out = spark.createDataFrame(rows, columns), []
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{folder}/{i}")
            out.append(spark.read.parquet(f"{tmp_path}/{folder}/{i}"))
            if i < 4:
                assert out[-1].columns == docs.columns
            docs = out[-1]
        if not rows:
            assert all(df.count() == 0 for df in out)
            continue
        kept = Counter(r.doc_id for r in out[0].collect())
        assert kept == Counter({None: 2, 5: 3, 6: 1, 7: 2} | {20 + k: 1 for k in range(30)})
        assert Counter(r.doc_id for r in out[1].collect()) == Counter({None: 1, 5: 1, 7: 2} | {20 + k: 1 for k in range(30)})
        assert all(r.text.endswith("write to <EMAIL>") and r.n_chars == len(r.text) for r in out[2].filter("doc_id = 5").collect())
        assert {(r.row, r.shard, r.spans) for r in out[3].collect()} == {(7, 1, "s")}
        pieces = out[4].groupBy("doc_id").agg({"length": "sum"}).collect()
        assert {r.doc_id for r in pieces} == {r.doc_id for r in out[3].collect()}


def by_hand(documents):
    """What the first two stages leave, from the operators' brute-force checks."""
    kept = {}
    for r in documents.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n, chars = len(words), sum(map(len, words))
        symbols = len(re.findall("[#*$%&|<>]", r.text or ""))
        bad = n < 50 or 2 * len(covered) > n or 4 * symbols > n or 2 * (len(lines) - len(set(lines))) > len(lines) or chars < 2 * n or chars > 15 * n
        if not bad:
            folded = [w.translate(FOLD) for w in words]
            kept[r.doc_id] = {tuple(folded[k : k + 5]) for k in range(n - 4)}
    least = {d: d for d in kept}
    for a in sorted(kept):
        for b in sorted(kept):
            if b < a and 100 * len(kept[a] & kept[b]) >= 75 * len(kept[a] | kept[b]):
                low, high = sorted((least[a], least[b]))
                least = {d: low if x == high else x for d, x in least.items()}
    return sorted(d for d in kept if least[d] == d)


def test_the_first_stages_against_brute_force(documents, stages):
    assert ids(stages[1][1]) == by_hand(documents)
