"""The pipeline against plain Python over a planted fixture, and fitted models against slow scores."""

import math
import re
from collections import Counter, defaultdict
from pathlib import Path
from random import Random

import pytest

import corpus_pipeline
from bankrec.llm import language_id, quality_classifier, queries

MODEL = queries.model_bytes() if Path("/opt/tokenizers/piece_bpe_32k.model").exists() else None
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _words(text):
    return re.findall(r"[^ \t-\r]+", text or "")


def _quality(docs):
    hosts, lines = defaultdict(set), defaultdict(set)
    for d in docs:
        hosts[d["source"]].add(d["text"] or "")
        for line in (d["text"] or "").split("\n"):
            lines[d["source"], tuple(_words(line.lower()))].add(d["text"])
    out = []
    for d in docs:
        words = _words(d["text"])
        grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        often = Counter(grams)
        repeated = len({i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)})
        if len(words) < 10 or 100 * repeated > 20 * len(words):
            continue
        left = []
        for line in d["text"].split("\n"):
            key = tuple(_words(line.lower()))
            n = len(lines[d["source"], key])
            if not (key and n > 4 and (100 * n > 2 * len(hosts[d["source"]]) or n > 1000)):
                left.append(line)
        if 100 * len(_words("\n".join(left))) >= 30 * len(words):
            out.append(d | {"text": "\n".join(left), "n_chars": len("\n".join(left))})
    return out


def _order(d):
    return d["doc_id"] is None, d["doc_id"] or 0, d["text"]


def _line_dedup(docs):
    seen, gone = {}, defaultdict(set)
    for d in sorted(docs, key=_order):
        lines = [(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate(d["text"].split("\n")) if _words(x)]
        for at in range(len(lines) - 2):
            where = (_order(d), at)
            if seen.setdefault(tuple(x for _, x in lines[at:at + 3]), where) != where:
                gone[_order(d)] |= {i for i, _ in lines[at:at + 3]}
    out = []
    for d in docs:
        text = "\n".join(x for i, x in enumerate(d["text"].split("\n")) if i not in gone[_order(d)])
        if not gone[_order(d)] or _words(text):
            out.append(d | {"text": text, "n_chars": len(text)})
    return out


def _one_of_each(docs):
    rows = sorted({_order(d): d for d in docs}.values(), key=_order)
    sets = []
    for d in rows:
        ws = _words(d["text"].lower())
        sets.append({tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    head = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    head[i] = min(head[i], head[j])
    return [d for i, d in enumerate(rows) if head[i] == i]


def _without_benchmark(docs, items):
    other, word = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    grams = set()
    for text in items:
        ws = re.findall(word, text.lower())
        n = min(10, len(ws))
        grams |= {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1) if n}
    out = []
    for d in docs:
        ws = re.findall(word, d["text"].lower())
        hit = {p for n in {len(g) for g in grams} for i in range(len(ws) - n + 1) if tuple(ws[i:i + n]) in grams
               for p in range(i, i + n)}
        if 100 * len(hit) > 50 * len(ws):
            continue
        if hit:
            parts, tail = re.findall(f"{other}*{word}", d["text"]), re.search(f"{other}*$", d["text"])[0]
            text = "".join(x for i, x in enumerate(parts) if i not in hit) + tail
            d = d | {"text": text, "n_chars": len(text)}
        out.append(d)
    return out


def _encoded(docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    ids = [lib.encode(d["text"]) for d in docs]
    return [d | {"ids": i, "n_tokens": len(i), "same": lib.decode(i) == d["text"]} for d, i in zip(docs, ids, strict=True)]


def _planted():
    rng = Random(5)

    def fresh(n):
        return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(4, 8))) for _ in range(n))

    notice = {"a": fresh(30), "b": fresh(30).upper()}
    item, short = fresh(25), fresh(6)
    passage, body = [fresh(8) for _ in range(4)], fresh(40)
    texts = [(i, "ab"[i % 2], f"{fresh(25)}\n  {notice['ab'[i % 2]]} \n{fresh(15)}") for i in range(100, 116)]
    half = item.split()
    texts += [
        (1, "a", f"{body}\n{notice['a']}"), (2, "b", f"{body}\n{notice['b']}"),             # alike without their notices only
        (3, "a", f"{fresh(4)}\n{notice['a']}"),                                             # little else than the notice
        (4, "c", "\n".join([fresh(12), *passage, fresh(12)])), (5, "c", "\n".join(passage)),  # nothing is left of 5
        (6, "d", "\n".join([fresh(12), " " + passage[0] + "\t", "", *passage[1:], fresh(9)])),
        (7, "a", f"{fresh(15)} {' '.join(half[:6])}\n{notice['a']}\n{' '.join(half[6:14])} {fresh(15)}."),   # a window once the notice went
        (8, "c", f"{fresh(5)} {item}"), (9, "c", f"{fresh(20)}, {short.title()}! {fresh(20)} é😀  ▁."),
        (10, "c", None), (11, "c", ""), (12, None, fresh(9)), (13, None, " ".join([fresh(6)] * 8)),
        (14, None, fresh(30)), (14, None, f"{body} {fresh(2)}"), (None, "c", fresh(30)), (None, "c", f"{body} {fresh(1)}")]
    texts += [(15, "c", fresh(30))] * 2 + [(None, "d", fresh(30))] * 2
    docs = [{"doc_id": i, "text": t, "lang": "en", "source": s, "n_chars": len(t or "")} for i, s, t in texts]
    return docs, [item, short]


@pytest.mark.skipif(MODEL is None, reason="no vocabulary")
def test_pipeline_run_is_the_brute_force(spark, tmp_path):
    docs, items = _planted()
    spark.createDataFrame([tuple(d.values()) for d in docs], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    steps = [docs]
    for stage in (_quality, _line_dedup, _one_of_each, lambda d: _without_benchmark(d, items), _encoded):
        steps.append(stage(steps[-1]))
    kept = [Counter(map(_order, s)) for s in steps[1:]]
    assert all(a != b for a, b in zip(kept[:3], kept[1:4], strict=True))         # every stage has something to do
    ids = [{d["doc_id"] for d in s} for s in steps]
    assert 3 in ids[0] - ids[1] and 5 in ids[1] - ids[2] and 2 in ids[2] - ids[3] and 8 in ids[3] - ids[4]
    assert next(d for d in steps[4] if d["doc_id"] == 7) not in steps[3]
    assert found.columns == list(steps[5][0])
    got = sorted((r.asDict() for r in found.collect()), key=_order)
    assert got == sorted(steps[5], key=_order)


def _softmax(row):
    e = [math.exp(x - max(row)) for x in row]
    return [x / sum(e) for x in e]


def _slow_language(net, text):
    data, total, weight = text.encode(), [0.0] * len(net.labels), 0.0
    for lo in range(0, len(data), language_id.WINDOW):
        part = data[lo:lo + language_id.WINDOW]
        cells = [net.embedding[b] for b in part.ljust(language_id.WINDOW, b"\0")]
        hidden = []
        for width, filters, shift in zip(language_id.WIDTHS, net.filters, net.shifts, strict=True):
            flat = [[x for c in cells[i:i + width] for x in c] for i in range(len(cells) - width + 1)]
            for k in range(filters.shape[1]):
                column = filters[:, k].tolist()
                hidden.append(max(0.0, max(sum(map(float.__mul__, map(float, f), column)) for f in flat) + float(shift[k])))
        p = _softmax([sum(h * float(net.out[i, k]) for i, h in enumerate(hidden)) + float(net.bias[k]) for k in range(len(total))])
        letters = 1e-6 + sum(chr(b).isalpha() if b < 128 else 1 for b in part)
        total, weight = [t + letters * x for t, x in zip(total, p, strict=True)], weight + letters
    return max((t / weight, name) for t, name in zip(total, net.labels, strict=True))


def test_language_scores_of_a_fitted_network(spark):
    rng = Random(1)
    alphabets = {"xx": "abcdefgh", "yy": "ijklmnop", "zz": "äöüßqrst"}
    rows = [(i, lang := "xyz"[i % 3] * 2, " ".join("".join(rng.choices(alphabets[lang], k=5)) for _ in range(rng.choice((8, 70)))))
            for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    net = language_id.learn(docs.where("doc_id < 180"))
    got = {r.doc_id: r for r in language_id.predict(docs, net).collect()}
    assert all(got[i].lang_pred == lang for i, lang, _ in rows)
    for i, _, text in rows[180:186]:
        score, name = _slow_language(net, text)
        assert (got[i].lang_pred, got[i].score) == (name, pytest.approx(score, abs=1e-4))


def _slow_quality(model, text):
    full, data = (1 << 64) - 1, text.encode()
    found = set()
    for size in (1, 2, 3, 4):
        for i in range(len(data) - size + 1):
            found.add(((int.from_bytes(bytes([size]) + data[i:i + size]) * 0x9E3779B97F4A7C15) & full) >> 48)
    words, lines = data.split(), [x.strip() for x in data.split(b"\n") if x.strip()]
    for kind, marks in ((1, [a == b for a, b in zip(words, words[1:])]), (2, [x in lines[:i] for i, x in enumerate(lines)])):
        run = longest = 0
        for m in marks:
            run = run + 1 if m else 0
            longest = max(longest, run)
        codes = [*range(1, min(4, longest) + 1), *(100 + k for k in range(1, 10 * sum(marks) // max(1, len(marks)) + 1))]
        for x in ((kind << 40) + c for c in codes):
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
            found.add((x ^ (x >> 31)) >> 48)
    margin = sum(float(model.weights[f]) for f in found) / math.sqrt(len(found)) + model.shift
    return 1 / (1 + math.exp(-model.slope * (margin - model.middle)))


def test_quality_scores_of_a_fitted_model(spark):
    rng = Random(2)

    def text(good):
        words = ["".join(rng.choices("abcdefghi" if good else "rstuvwxyz", k=5)) for _ in range(30)]
        return " ".join(words) if good else "\n".join(words[k // 2] for k in range(30))

    rows = [(i, text(i % 2)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality_classifier.learn(docs, docs.where("doc_id < 80").selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i, _ in rows)
    for i, t in rows[76:90]:
        assert got[i] == pytest.approx(_slow_quality(model, t), abs=1e-6)
