import random

from tracemill.llm.spam import stuffed_share


def nouns(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(n)]


def test_list_of_distinct_nouns():
    assert stuffed_share("\n".join(nouns(80))) > 0.5
    assert stuffed_share(", ".join(nouns(80))) > 0.5
    assert stuffed_share("\n".join(nouns(12))) == 0


def test_list_that_repeats_after_more_than_sixty_words():
    assert stuffed_share("\n".join(nouns(100) * 3)) > 0.5


def test_prose_and_code_are_no_lists():
    words = nouns(400)
    prose = "\n".join(f"The {words[i]} of a {words[i + 1]} was {words[i + 2]} when we saw it." for i in range(0, 390, 3))
    assert stuffed_share(prose) == 0
    code = "\n".join(f"def {w}(x):\n    {w}_all = x.{w}(1)" for w in words[:60])
    assert stuffed_share(code) < 0.5


def test_rules_by_what_finds_them():
    from collections import Counter

    from tracemill.llm.spam import stuffed_shares

    links = "\n".join(f"https://{w}.example/{w}" for w in nouns(12))
    priced = "\n".join(f"{w} €{i}" for i, w in enumerate(nouns(40)))
    long_list = " ".join(nouns(150) * 2)  # said again in its order, at a lag that no window has
    rules: Counter = Counter()
    shares = stuffed_shares([links, priced, long_list, None, ""], rules)
    assert shares[0] == 1 and shares[1] > 0.5 and shares[2] == 1 and shares[3:] == [0, 0]
    assert rules["lag"] >= len(links) - 12 and set(rules) <= {"gap", "lag", "list"}


def test_links_and_prices_beside_sentences_are_fine():
    words = nouns(400, 4)
    linked = "\n".join(f"- https://{words[i]}.example : the {words[i + 1]} of this {words[i + 2]} is told here, and why it was moved." for i in range(0, 57, 3))
    priced = "\n".join(f"We paid $ {i} for the {words[i]} that {words[i + 1]} lost when it moved, and the {words[i + 2]} of {words[i + 3]} by {words[i + 4]} is not yet here." for i in range(0, 390, 5))
    assert stuffed_share(linked) <= 0.5 and stuffed_share(priced) <= 0.5
