import random
import re

import numpy as np
import pytest
from odd_documents import empty_frame, odd_frame, odd_texts, prose

from catchment.llm import language_id, pii, toxicity

FRENCH = "le la les de des et est une que dans pour avec sur oiement étreaux quelle".split()


def french(seed, words=80):
    rng = random.Random(seed)
    return " ".join(rng.choice(FRENCH) + rng.choice(("", "", "ion", "ai")) for _ in range(words))


@pytest.fixture(scope="module")
def languages():
    return language_id.train({"en": [prose(i, 100) for i in range(30)], "fr": [french(i) for i in range(30)],
                              "ru": ["это просто слова и ещё слова " * 5]})


def test_languages_of_unseen_texts(languages):
    texts = [prose(900 + i, 40) for i in range(20)] + [french(900 + i, 40) for i in range(20)]
    got = [lang for lang, _, _ in language_id.label_texts(languages, texts)]
    assert got == ["en"] * 20 + ["fr"] * 20


def test_spans_of_mixed_text(languages):
    text = " ".join([*prose(901, 30).split(), *french(902, 30).split(), "слова", "и", "слова"])
    ((lang, score, spans),) = language_id.label_texts(languages, [text])
    assert [s[2] for s in spans] == ["en", "fr", "ru"]
    assert spans[0][0] == 0 and spans[-1][1] == 62
    assert abs(spans[1][0] - 30) <= 2 and 0 < score < 0.7


def test_numbers_of_any_kind_are_no_letters(languages):
    got = list(language_id.label_texts(languages, ["\u00b2 \u2167 \u00bd 12", "x\u00b2"]))
    assert got[0] == ("und", 0.0, []) and got[1][0] != "und"


def test_script_rules_out_languages(languages):
    ((lang, score, _),) = language_id.label_texts(languages, ["слова"])
    assert (lang, score) == ("ru", 1.0)


def test_viterbi_equals_brute_force():
    from itertools import product
    rng = np.random.default_rng(0)
    lengths = np.array([3, 1, 5, 0, 4])
    scores = rng.normal(0, 6, (lengths.sum(), 3))
    starts = np.cumsum(lengths) - lengths
    label = language_id.viterbi(scores, starts, lengths)
    for s, n in zip(starts, lengths):
        def value(path):
            return sum(scores[s + i, x] for i, x in enumerate(path)) - language_id.SWITCH * sum(
                a != b for a, b in zip(path, path[1:]))
        if n:
            best = max(product(range(3), repeat=int(n)), key=value)
            assert np.isclose(value(best), value(label[s:s + n]))


def test_identify_odd_rows(frame, languages):
    rows = language_id.identify(odd_frame(frame), languages).collect()
    assert len(rows) == len(odd_texts())
    by_text = {r.doc_id: r for r in rows}
    for i in (4, 5, 6, 10):
        assert (by_text[i].lang_pred, by_text[i].score, by_text[i].spans) == ("und", 0.0, "")
    assert by_text[9].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in rows)
    assert language_id.identify(empty_frame(frame), languages).count() == 0


def test_nothing_learned_is_undetermined(frame):
    model = language_id.fit_languages(empty_frame(frame))
    rows = language_id.identify(odd_frame(frame), model).collect()
    assert {r.lang_pred for r in rows} == {"und"}


def test_fit_ignores_nulls(frame):
    model = language_id.fit_languages(odd_frame(frame))
    assert model.languages == ["de", "en", "fr"]


# The fixed patterns, read as they are written; checked against the linear search for emails.
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and sum(
                    sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    bits = ["a@b.c", "@", ".", "x_y%z", "-", "+", "1", "255", "256", "0", " ", "(", ")", "4111 1111 1111 1111", "é",
            "12", "com", "\n", "@d-e.f-", "+49 30 1234-5678", "10.0.0.1", "5500005555555559", "..", "000012"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" + "(" * 200_000, "x@" + "y." * 100_000):
        pii.find(pii.train([]), [text])


def messages_by_enumeration(field, scores, edges, kinds):
    from itertools import product
    weight = np.zeros((len(scores), 5))
    for path in product(range(5), repeat=len(scores)):
        value = sum(scores[i, x] for i, x in enumerate(path)) + sum(
            (field.chain, field.skip)[k][path[a], path[b]] for (a, b), k in zip(edges, kinds))
        for i, x in enumerate(path):
            weight[i, x] += np.exp(value)
    return weight / weight.sum(1, keepdims=True)


def test_messages_are_exact_on_a_tree_and_close_on_a_loop():
    rng = np.random.default_rng(1)
    field = pii.Field(np.zeros((pii.N_FEATURES, 5)), rng.normal(0, 0.5, (5, 5)), 0.5 * np.eye(5))
    scores = rng.normal(0, 1, (5, 5))
    tree = np.array([(0, 1), (1, 2), (1, 3), (3, 4)])
    kinds = np.array([0, 0, 1, 0])
    assert np.allclose(pii.beliefs(field, scores, tree, kinds),
                       messages_by_enumeration(field, scores, tree, kinds), atol=5e-3)
    loop = np.array([(0, 1), (1, 2), (2, 3), (0, 3)])
    kinds = np.array([0, 0, 0, 1])
    assert np.allclose(pii.beliefs(field, scores[:4], loop, kinds),
                       messages_by_enumeration(field, scores[:4], loop, kinds), atol=0.05)


def test_a_repeated_token_takes_the_label_of_its_twin():
    """Skip edges carry a label to a distant token that its own features leave open."""
    text = "call 5552186 now " + "word " * 50 + "again 5552186"
    spans, chain, skip = pii.graph(text)
    assert len(spans) == 2 and skip == [(0, 1)] and chain == []
    field = pii.Field(np.zeros((pii.N_FEATURES, 5)), np.zeros((5, 5)), 2 * np.eye(5) - 1)
    alone = np.array([[0, 0, 0, 0, 6.0], [0.5, 0, 0, 0, 0]])
    assert pii.beliefs(field, alone, np.zeros((0, 2), int), np.zeros(0, int))[1].argmax() == 0
    assert pii.beliefs(field, alone, np.array(skip), np.array([1]))[1].argmax() == 4


def test_personal_data_of_odd_rows(frame):
    df = odd_frame(frame)
    rows = pii.find_personal_data(df, pii.fit_field(df)).collect()
    assert len(rows) == len(odd_texts())
    got = {r.doc_id: r for r in rows}
    text = odd_texts()[13][1]
    base = plain_spans(text)
    assert (got[11].n_email, got[11].n_phone, got[11].n_ip) == (1, 1, 1)
    written = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
    assert set(written.split(",")) <= set(got[11].spans.split(","))
    assert got[4].spans == got[5].spans == ""
    assert pii.find_personal_data(empty_frame(frame), pii.fit_field(empty_frame(frame))).count() == 0


def test_subsequence_kernel_equals_enumeration():
    from itertools import combinations
    alphabet = {c: i + 1 for i, c in enumerate("^abcdeilmnorst")}
    kernel = toxicity.Kernel(alphabet)
    words = ["^moron", "^mo.ron", "^idiot", "^stall", "^ab", "^aaaa", "^xyz"]
    kernel.prepare(["^moron", "^idiot", "^aaaa"])

    def image(word):
        out = {}
        for t in combinations(range(len(word)), 3):
            key = tuple(word[i] for i in t)
            if t[2] - t[0] < toxicity.SPAN and all(c in alphabet for c in key):
                out[key] = out.get(key, 0) + toxicity.DECAY ** (t[2] - t[0] + 1)
        return out

    def value(a, b):
        a, b = image(a), image(b)
        size = np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        return (sum(v * b.get(k, 0) for k, v in a.items()) / size) ** toxicity.POWER if size else 0.0

    want = [[value(w, m) for m in kernel.landmarks] for w in words]
    assert np.allclose(kernel.values(words), want, atol=1e-5)


@pytest.fixture(scope="module")
def machine():
    rng = random.Random(1)
    insults = ["moronic", "wretched", "scumbag"]

    def put(text, words):
        own = text.split(" ")
        for w in words:
            own.insert(rng.randint(0, len(own)), w)
        return " ".join(own)

    clean = [prose(i, 60).replace("loser", "other") for i in range(200)]
    toxic = [put(prose(500 + i, 60).replace("loser", "other"), rng.choices(insults, k=3)) for i in range(80)]
    return toxicity.train(toxic, clean), put


def test_held_out_insults_are_found_with_inserted_characters(machine):
    own, put = machine
    clean = [prose(2000 + i, 60).replace("loser", "other") for i in range(60)]
    assert (own.scores(clean) >= 0.5).mean() < 0.05
    for forms in (["moronic"], ["MORONIC!"], ["mo.ronic"], ["wret-ched"], ["scum*bag"], ["s", "c", "u", "m", "b", "a", "g"]):
        dirty = [t + " " + " ".join(forms) + " " + prose(1, 5) for t in clean]
        assert (own.scores(dirty) >= 0.5).mean() > 0.95, forms


def test_toxicity_of_odd_rows(frame, machine):
    rows = toxicity.score_toxicity(odd_frame(frame), machine[0]).collect()
    assert len(rows) == len(odd_texts())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.score_toxicity(empty_frame(frame), machine[0]).count() == 0


def test_nothing_to_learn_scores_zero(frame):
    labels = frame([(1, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    machine = toxicity.fit_machine(odd_frame(frame), labels)
    assert {r.score for r in toxicity.score_toxicity(odd_frame(frame), machine).collect()} == {0.0}


def test_tokens_with_one_unit_are_evaluated_once(machine, monkeypatch):
    learner, _ = machine
    learner.cache.clear()
    seen = []
    values = toxicity.Kernel.values

    def counted(kernel, units):
        seen.extend(units)
        return values(kernel, units)

    monkeypatch.setattr(toxicity.Kernel, "values", counted)
    learner.margins(["Alpha, alpha. (alpha) beta!", "... alpha? --", ""])
    learner.margins(["beta gamma alpha; gamma.", "*beta* !!"])
    assert sorted(seen) == sorted(toxicity.MARK + u for u in ("alpha", "beta", "gamma", ""))
    learner.cache.clear()


def test_margins_of_many_texts_are_those_of_each_sentence(machine):
    learner, put = machine
    texts = ["", " . . ", "no end", "one. two! three? four", "a. a. a a", *[row[1] or "" for row in odd_texts()],
             *[put(prose(700 + i, 50), ["loser", "x.y"]) for i in range(8)]]
    want = []
    for text in texts:
        learner.cache.clear()
        each = [sum(float(learner.unit_values([toxicity.unit(t)])[0]) for t in set(s)) for s in toxicity.sentences(text)]
        want.append(max(each, default=0.0) + learner.bias)
    for size in (1, 5, len(texts)):
        learner.cache.clear()
        got = np.concatenate([learner.margins(texts[i:i + size]) for i in range(0, len(texts), size)])
        assert np.allclose(got, want, atol=1e-4)
    learner.cache.clear()
