import numpy as np
import pytest
from pyspark.sql import functions as F

from bankrec.operators import similarity, suggestions, transcripts
from test_reconcile import _ambiguous

VECTORS = "caso_id long, embedding array<float>"


def frame(spark, vectors):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in vectors], VECTORS)


def brute(opened, resolved, k):
    out = []
    for i, a in opened:
        scored = []
        for j, b in resolved:
            if i == j:
                continue
            a_, b_ = np.asarray(a, "float32").astype(float), np.asarray(b, "float32").astype(float)
            norm = np.linalg.norm(a_) * np.linalg.norm(b_)
            scored.append((-round(a_ @ b_ / norm if norm else 0.0, 12), j))
        out += [(i, r, j, round(-s, 6)) for r, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_order(spark):
    got = similarity.top_k(frame(spark, [(1, [1, 0])]), frame(spark, [(2, [1, 0]), (3, [0, 1])])).collect()
    assert [(r.vizinho_id, round(r.similaridade, 6)) for r in sorted(got, key=lambda r: r.rank)] == [(2, 1.0), (3, 0.0)]


@pytest.mark.parametrize("kind,pivots,block", [("clusters", 8, 16), ("random", 64, 4096), ("copies", 4, 8)])
def test_equals_brute_force(spark, kind, pivots, block):
    rng = np.random.default_rng(9)
    if kind == "clusters":
        centres = rng.normal(0, 1, (8, 12))
        base = np.vstack([c + rng.normal(0, 0.02, (30, 12)) for c in centres])
    elif kind == "copies":
        base = rng.normal(0, 1, (150, 6))
        base[::3] = base[0]
    else:
        base = rng.normal(0, 1, (200, 12))
    base[5] = 0
    resolved = [(i, v) for i, v in enumerate(base)]
    opened = [(i, base[i] + rng.normal(0, 0.01, base.shape[1])) for i in range(0, 40, 3)] + [(7, base[7]), (999, base[5])]
    got = similarity.top_k(frame(spark, opened), frame(spark, resolved), 3, pivots, block).collect()
    assert sorted((r.caso_id, r.rank, r.vizinho_id, round(r.similaridade, 6)) for r in got) == brute(opened, resolved, 3)


def test_clusters_are_pruned(spark):
    rng = np.random.default_rng(2)
    centres = np.eye(8)
    base = np.vstack([c + rng.normal(0, 0.01, (30, 8)) for c in centres])
    pivots = similarity._unit(centres)
    batch = __import__("pandas").DataFrame({"caso_id": range(len(base)), "embedding": list(base)})
    cells = next(similarity._assign(pivots)(iter([batch]))).groupby("celula").agg(
        n=("id", "size"), p=("proximidade", "min")).reset_index()
    visits = next(similarity._visits(pivots, [tuple(r) for r in cells.itertuples(index=False)], 3)(iter([batch])))
    assert len(visits) == len(base)              # one cell each, out of eight


def test_nothing_resolved(spark):
    assert similarity.top_k(frame(spark, [(1, [1, 0])]), frame(spark, [])).count() == 0


def test_texts_and_prompts(spark, movimentos, linhas):
    m, l, found, options, _ = _ambiguous(movimentos, linhas)
    texts = {r.caso_id: r.texto for r in suggestions.case_texts(found, m).collect()}
    assert texts[1] == "ANCORA APOGEU,LDA | TRANSF | -100.00 EUR"
    assert suggestions.case_texts(found, m.where("false")).where("caso_id = 2").first().texto == \
        "Ancora Apogeu |  | -100.00 EUR"
    none = spark.createDataFrame([], "caso_id long, rank int, vizinho_id long, similaridade double")
    prompt = suggestions.prompts(found, options, l, m, none).where("caso_id = 1").first().prompt
    assert "linha 5 (pagamento)" in prompt and "linha 9 (pagamento)" in prompt
    assert "(vazia)" in prompt and suggestions.NO_EXAMPLES in prompt
    near = spark.createDataFrame([(1, 1, 2, 0.987)], "caso_id long, rank int, vizinho_id long, similaridade double")
    solved = found.selectExpr("id", "movimento_id", "dia", "empresa", "valor", "grupo", "n_candidatos",
                              "if(id = 2, 'ana', null) resolvido_por", "if(id = 2, 'novo', null) resolucao")
    prompt = suggestions.prompts(solved, options, l, m, near).first().prompt
    assert "resolvido como: novo (similaridade 0.99)" in prompt


def test_candidates_of_a_group_are_one_text(movimentos, linhas):
    _, l, _, options, _ = _ambiguous(movimentos, linhas)
    rows = suggestions.candidate_texts(options, l).collect()
    assert len(rows) == 1
    assert sum(r.texto.count("- linha") for r in rows) == 2


def test_a_prompt_is_its_parts_around_the_pages_of_its_group(spark, movimentos, linhas):
    m, l, found, options, _ = _ambiguous(movimentos, linhas)
    none = spark.createDataFrame([], "caso_id long, rank int, vizinho_id long, similaridade double")
    whole = {r.caso_id: r.prompt for r in suggestions.prompts(found, options, l, m, none).collect()}
    page, = suggestions.candidate_texts(options, l).collect()
    for r in suggestions.prompt_parts(found, m, none).collect():
        assert r.grupo == page.grupo and whole[r.caso_id] == "\n".join([r.antes, page.texto, r.depois])


def answers(spark, *rows):
    return spark.createDataFrame(rows, "caso_id long, texto string, ts long").withColumn("ts", F.timestamp_seconds("ts"))


def test_answers_to_no_case_are_listed_and_need_a_time(spark, movimentos, linhas):
    _, _, found, _, _ = _ambiguous(movimentos, linhas)
    given = answers(spark, (1, "a", 1), (9, "b", 1), (9, "b", 1), (None, "c", None))
    assert sorted((r.caso_id or 0, r.texto) for r in suggestions.rejected_answers(found, given).collect()) == [
        (0, "c"), (9, "b"), (9, "b")]
    with pytest.raises(ValueError):
        suggestions.parse_answers(given.drop("ts"))


@pytest.mark.parametrize("text,suggestion,why", [
    ('{"linha_id": 5, "justificacao": "bate com o histórico"}', "linha_id=5", "bate com o histórico"),
    ('Claro!\n{"linha_id": null, "justificacao": "nenhuma"}\nfim', "novo", "nenhuma"),
    ('{"justificacao": "x"}', "novo", "x"),
    ("sem resposta", None, suggestions.NOT_JSON + "sem resposta"),
    ('{"linha_id": 5', None, suggestions.NOT_JSON + '{"linha_id": 5'),
    ('{"a": 1} e {"linha_id": 2}', None, suggestions.NOT_JSON + '{"a": 1} e {"linha_id": 2}'),
])
def test_answers(spark, movimentos, linhas, text, suggestion, why):
    _, _, found, _, _ = _ambiguous(movimentos, linhas)
    got = suggestions.apply_suggestions(found, answers(spark, (1, text, 2), (1, "zzz", 1), (9, text, 2)))
    one, two = got.orderBy("id").collect()
    assert (one.resolucao_sugerida, one.justificacao_sugerida) == (suggestion, why)
    assert one.resolvido_por is None and two.resolucao_sugerida is None and two.justificacao_sugerida is None


def test_transcripts(spark):
    rows = [(1, 0, "assistant", "Olá", None), (1, 1, "assistant", " mundo ", None),
            (2, 0, "assistant", " a", None), (2, 1, "tool", None, "t1"), (2, 2, "assistant", "b", None),
            (2, 3, "tool", None, "t2"), (3, 0, "tool", None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, name string")
    got = {r.conv_id: (r.resposta, r.ferramentas) for r in transcripts.fold(df).collect()}
    assert got == {1: ("Olá mundo", []), 2: ("ab", ["t1", "t2"]), 3: ("", [])}
    long = spark.range(10_001).selectExpr("1L conv_id", "id turn", "if(id < 3, 'tool', 'assistant') role",
                                          "if(id = 3, '  oi', 'x') text", "cast(null as string) name")
    assert [len(r.resposta) for r in transcripts.fold(long).collect()] == [2 + 10_001 - 4]


@pytest.mark.parametrize("k", [1, 3])
def test_best_of_wide_blocks_without_sorting_rows(k, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = similarity._unit(rng.normal(0, 1, (700, 6)))
    vectors[100:400:7] = vectors[3]                      # ties
    asked = np.vstack([vectors[:20], similarity._unit(rng.normal(0, 1, (20, 6)))])
    ids = np.sort(rng.permutation(2000)[:700])
    ids[10] = ids[9]                                     # an id that comes twice
    own = np.concatenate([ids[:20], np.arange(5000, 5020)])
    real = np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *p, **q: real(a, *p, **q) if np.ndim(a) == 1 else pytest.fail("rows are sorted"))
    pd = __import__("pandas")
    got = similarity._compare(k)(None, pd.DataFrame({"id": own, "vetor": list(asked)}), pd.DataFrame({"id": ids, "vetor": list(vectors)}))
    want = []
    for q, v in zip(own, asked):
        sims = np.round(vectors @ v, 12)
        want += [(q, ids[j]) for j in sorted(np.nonzero(ids != q)[0], key=lambda j: (-sims[j], j))[:k]]
    assert list(zip(got["caso_id"], got["vizinho_id"])) == want
