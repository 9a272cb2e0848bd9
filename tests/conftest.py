import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from blockloom.session import local_session

    session = local_session("tests", cores="8", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def page(spark):
    """One-page DataFrame from an HTML string."""

    def make(*htmls):
        return spark.createDataFrame(list(enumerate(htmls)), "page_id bigint, html string")

    return make


FOODS = ["salt", "sugar", "butter", "flour", "milk", "lime", "basil", "rice", "pepper", "cream"]
VERBS = ["Mix", "Stir", "Bake", "Boil", "Chop", "Whisk", "Fry", "Serve"]


def recipe(i: int):
    """An invented recipe page and its label record."""
    import random

    rng = random.Random(i)
    title = f"{rng.choice(FOODS).title()} {rng.choice(['Soup', 'Cake', 'Salad', 'Pie'])} number {i}"
    ingredients = [f"{rng.randint(1, 9)} cups {f}" for f in rng.sample(FOODS, 4)]
    directions = [f"{rng.choice(VERBS)} the {rng.choice(FOODS)} with the {rng.choice(FOODS)} for {rng.randint(2, 50)} minutes." for _ in range(3)]
    items = "".join(f'<li class="ingredient">{x}</li>' for x in ingredients)
    steps = "".join(f"<p>{x}</p>" for x in directions)
    noise = "".join(f"<div>Read more about {rng.choice(FOODS)}, comment {rng.randint(1, 999)}</div>" for _ in range(8))
    html = (
        f"<html><body><nav>Home</nav><h1>{title}</h1><div>{rng.choice(VERBS)} with us</div><h2>Ingredients</h2><ul>{items}</ul>"
        f"<h2>Directions</h2>{steps}<h3>Comments</h3>{noise}</body></html>"
    )
    return f"recipe_{i:05d}", html, title, ["0", *ingredients], ["0", *directions]


@pytest.fixture(scope="session")
def recipes(spark):
    """(pages, labels) of invented recipes."""
    rows = [recipe(i) for i in range(60)]
    pages = spark.createDataFrame([(r[0], r[1]) for r in rows], "file string, html string")
    labels = spark.createDataFrame(
        [(r[0], *r[2:]) for r in rows],
        "file string, title string, ingredients array<string>, directions array<string>",
    )
    return pages, labels


@pytest.fixture(scope="session")
def trained(spark, recipes):
    from blockloom.plans.training import labeled_blocks, train

    pages, labels = recipes
    return train(labeled_blocks(labels, pages), ["file", "idx"], by=["file"], rounds=4, depth=3, max_terms=60)


@pytest.fixture(scope="session")
def model(trained):
    return trained.model
