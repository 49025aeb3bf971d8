"""The pipeline against a brute-force version, and its stages on hard and empty tables."""

import os
import random

import corpus_pipeline
from codesift.llm import quality_rules
from tests.llm import test_near_copies as near
from tests.llm.conftest import prose
from tests.llm.test_rules_secrets import counted, found
from tests.llm.test_tokens import crc, ids


def kept_by_rules(text):
    words, chars, symbols, dup, repeated = counted(text)
    lines = [x for x in (text or "").split("\n") if near.WORD.search(x)]
    stops = sum(w.lower() in quality_rules.STOP_WORDS for w in near.WORD.findall(text or ""))
    return (words >= 50 and 100 * repeated <= 50 * words and 2 * words <= chars <= 12 * words and 100 * symbols <= 10 * words
            and 100 * stops >= words and 100 * dup <= 40 * len(lines))


def hidden(text):
    out, at, reach = "", 0, -1
    for a, _, _, b in found(text)[1]:
        out += (text[at:a] if a > at else "") + ("[REDACTED]" if a > reach else "")
        at, reach = max(at, b), max(reach, b)
    return out + text[at:]


def brute(texts, items):
    kept = [(i, t) for i, t in texts if kept_by_rules(t)]
    roots = near.slow_groups({near.slow_print(t) for _, t in kept})
    first = {}
    for i, t in kept:
        r = roots[near.slow_print(t)]
        first[r] = min(first.get(r, (i, t)), (i, t))
    clean = [(i, hidden(t)) for i, t in first.values() if not near.slow_hits(t, items)[1]]
    pieces = set()
    for i, t in clean:
        whole, at, k = ids(t) + [2], 0, 0
        while at < len(whole):
            n = len(whole) if len(whole) <= 1024 else 1024 if at else len(whole) % 1024 or 1024
            pieces.add((i, k, at, n, crc(whole[at:at + n])))
            at, k = at + n, k + 1
    return pieces


def corpus():
    pick = random.Random(11)
    items = [(1, prose(31, 30)), (2, prose(32, 12)), (3, prose(33, 9))]
    texts = [(k, prose(1000 + k, pick.choice([10, 60, 200, 1500]))) for k in range(60)]
    texts += [(100 + k, texts[k * 3][1]) for k in range(15)]
    texts += [(200 + k, near.near(pick, texts[3][1].split() * 5, k)) for k in range(4)]
    texts += [(300 + k, prose(2000 + k, 60) + " " + items[k % 3][1] + " " + prose(3000 + k, 40)) for k in range(9)]
    texts += [(400 + k, prose(4000 + k, 80) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + prose(5000 + k, 9)) for k in range(5)]
    texts += [(500 + k, prose(6000 + k, 80).replace(" ", "### ")) for k in range(5)] + [(600, None), (601, "")]
    return texts, items


def test_pipeline_against_brute_force(spark, tmp_path):
    texts, items = corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        os.path.join(tmp_path, "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(os.path.join(tmp_path, "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == brute(texts, items)
    fill = {}
    for r in got:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in fill.values():
        own.sort()
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:])) and sum(own[-1]) <= 1024


def test_stages_on_hard_and_empty_tables(spark, hard, none, tmp_path):
    spark.createDataFrame([(1, prose(31, 30)), (None, None)], "item_id long, text string").write.parquet(
        os.path.join(tmp_path, "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (hard, none):
            out = stage(spark, docs, str(tmp_path))
            n = out.count()
            assert n or docs is none
            if name != "best_fit_packing":
                assert out.columns == docs.columns


def test_contract():
    import __spark_entry__ as entry

    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= names
