from collections import Counter, defaultdict
from hashlib import md5

from fixtures import WORD, empty, messy, messy_rows

from haulbook.llm import mixing

WEIGHTS = {"lang": {"en": 3.0, "de": 0.0}, "source": {"src1": 2.0}}


def filled(given, children):
    """Budgets of (name, weight, capacity): the full ones are taken out until the rest can share by weight."""
    out, open_ones = {}, dict((name, (weight, capacity)) for name, weight, capacity in children)
    while open_ones:
        total = sum(weight for weight, _ in open_ones.values())
        full = [name for name, (weight, capacity) in open_ones.items() if total and weight and capacity * total <= given * weight]
        if not full:
            return out | {name: given * weight / total if total else 0.0 for name, (weight, _) in open_ones.items()}
        for name in full:
            out[name] = open_ones.pop(name)[1]
            given -= out[name]
    return out


def brute(rows, share, epochs):
    leaves = defaultdict(list)
    for doc_id, text, lang, source in rows:
        key = md5(f"{'null' if doc_id is None else doc_id}:{text or ''}".encode()).hexdigest()
        leaves[lang or "", source or ""].append((doc_id, len(WORD.findall(text or "")), key))
    tokens = {leaf: sum(row[1] for row in rows) for leaf, rows in leaves.items()}
    of_lang = Counter()
    for (lang, _), n in tokens.items():
        of_lang[lang] += n * epochs
    given = filled(
        int(sum(tokens.values()) * share), [(lang, WEIGHTS["lang"].get(lang, 1.0), n) for lang, n in of_lang.items()]
    )
    chosen = Counter()
    for lang in of_lang:
        mine = [leaf for leaf in leaves if leaf[0] == lang]
        budgets = filled(given[lang], [(leaf, WEIGHTS["source"].get(leaf[1], 1.0), tokens[leaf] * epochs) for leaf in mine])
        for leaf in mine:
            budget = int(budgets[leaf] + 1e-6)
            whole = budget // tokens[leaf] if tokens[leaf] else 0
            rest = budget - whole * tokens[leaf]
            units = defaultdict(list)
            for row in leaves[leaf]:
                units[int(md5(f"42:{whole}:{row[2]}".encode()).hexdigest()[:15], 16)].append(row)
            for row in leaves[leaf]:
                chosen.update((row[0], row[1], epoch) for epoch in range(whole))
            for place in sorted(units):
                rest -= sum(row[1] for row in units[place])
                if rest < 0:
                    break
                chosen.update((row[0], row[1], whole) for row in units[place])
    return chosen


def test_choice_equals_brute_force(spark):
    for share, epochs in ((0.5, 4), (0.03, 2), (3.0, 2)):
        found = mixing.mix(messy(spark), ("lang", "source"), WEIGHTS, share, epochs)
        mine = Counter((row["doc_id"], row["tokens"], row["epoch"]) for row in found.collect())
        assert mine == brute([row[:4] for row in messy_rows()], share, epochs)


def test_whole_tables_and_budget(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(row["doc_id"], row["text"], row["lang"], row["source"]) for row in docs.collect()]
    found = mixing.mix(docs, ("lang", "source"), WEIGHTS)
    assert Counter((row["doc_id"], row["tokens"], row["epoch"]) for row in found.collect()) == brute(rows, 0.5, 4)


def test_names_of_new_columns(spark):
    found = mixing.mix(messy(spark), ("lang", "source"), added=("a", "b"))
    assert found.columns == [*messy(spark).columns, "a", "b"] and {row["tokens"] for row in found.collect()} == {"theirs"}


def test_empty(spark):
    assert mixing.mix(empty(spark), ("lang", "source")).count() == 0
