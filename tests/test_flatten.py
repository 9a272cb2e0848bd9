from pyspark.sql import functions as F

from blockloom.functions.dom import PageWalker
from blockloom.operators.flatten import EXCLUDED_TAGS, MERGED_TAGS, SectionRules, html_blocks, page_text
from blockloom.operators.features import block_features
from blockloom.operators.sections import block_context

RECIPE = """<body><nav><li>skip</li></nav><h1 class="recipe-title">Lime Soup</h1><h2>Ingredients</h2><ul><li class="ing"
itemprop="recipeIngredient"><b>2 cups</b> lime juice</li><li> </li></ul><!-- x --><h2>Directions</h2><p>Stir <i>well</i>.</p>
<h3>Notes</h3><p>Calories: 12</p></body>"""


def walk(html, excluded=EXCLUDED_TAGS, merged=MERGED_TAGS, **options):
    return [(n.text, n.tag, n.depth) for n in PageWalker(excluded, merged, **options).walk(html)]


def test_recipe_page(page):
    rows = html_blocks(page(RECIPE), rules=SectionRules()).orderBy("idx").collect()
    assert [(r.text, r.tag, r.depth, r.section) for r in rows] == [
        ("Lime Soup", "h1", 2, None),
        ("Ingredients", "h2", 2, "ingredient"),
        ("2 cups lime juice", "li", 2, "ingredient"),
        ("Directions", "h2", 2, "direction"),
        ("Stir", "p", 2, "direction"),
        ("well", "i", 3, "direction"),
        (".", "p", 2, "direction"),
        ("Notes", "h3", 2, None),
        ("Calories: 12", "p", 2, None),
    ]
    assert [r.idx for r in rows] == list(range(9))
    assert {r.n_blocks for r in rows} == {9}
    assert rows[0]["class"] == ["recipe-title"]
    assert (rows[2]["class"], rows[2].itemprop, rows[2].id) == (["ing"], "recipeIngredient", "")


def test_recipe_features(page):
    rows = block_features(html_blocks(page(RECIPE), rules=SectionRules())).orderBy("idx").collect()
    item = rows[2]
    assert item.text_len == 17 and item.starts_with_digit is True and item.num_digits == 1
    assert item.contains_unit == 1 and item.contains_quantity_number == 1
    assert item.position_ratio == 0.25
    assert item.class_has_ing_keyword == 0 and item.is_under_current_ingredient_section == 1
    assert rows[0].class_has_title_keyword == 1 and rows[0].parent_tag == "None"
    assert rows[4].is_under_current_direction_section == 1


def test_malformed_nesting():
    assert walk("<body><p>a<p>b</div>c</body>") == [("a", "p", 2), ("b", "p", 3), ("c", "p", 3)]


def test_without_body():
    assert walk("hello<li>x</li>") == [("hello", "[document]", 1), ("x", "li", 1)]
    assert walk("<!DOCTYPE html><p>x</p>") == [("html", "[document]", 1), ("x", "p", 2)]


def test_scripts_and_comments_split_text():
    assert walk("<body>a<script>1</script>b</body>") == [("a", "body", 1), ("b", "body", 1)]
    assert walk("<body>a<!-- <p>no</p> -->b</body>") == [("a", "body", 1), ("b", "body", 1)]
    assert walk('<body><script>var s="</p><p>x";</script>y</body>') == [("y", "body", 1)]


def test_excluded_elements_go_with_their_content():
    assert walk("<body><footer>a<p>b</p></footer><button>c</button>d</body>") == [("d", "body", 1)]
    assert walk("<body><footer>a</body>", excluded=()) == [("a", "footer", 2)]
    # the first body that is not removed is the root
    assert walk("<nav><body>a</body></nav>b") == [("b", "[document]", 1)]


def test_list_items_merge():
    assert walk("<body><ul><li>a<ul><li>b</li></ul>c</ul><p>d</body>") == [("a b c", "li", 2), ("d", "p", 2)]
    assert walk("<body><li>a<li>b</body>") == [("a b", "li", 1)]
    assert walk("<body><ul><li><h2>Steps</h2>x</li></ul></body>") == [("Steps x", "li", 2)]


def test_entities_and_stray_signs():
    html = "<body><p>1 &lt; 2 &amp;amp; &frac12; &#189; &#x2153; &#150; &unknown; a < b && c</p></body>"
    assert walk(html)[0][0] == "1 < 2 &amp; ½ ½ ⅓ – &unknown a < b && c"


def test_entities_without_semicolon():
    assert walk("<body><p>a &amp</p><p>b &copy c &am</p></body>") == [("a &", "p", 2), ("b © c &am", "p", 2)]


def test_void_tags():
    assert walk("<body><p>a<br>b<img src='x>y'>c</p></body>") == [("a", "p", 2), ("b", "p", 2), ("c", "p", 2)]
    # an explicit end tag of an earlier void tag does not even split the text
    assert walk("<body>a<br>b</br>c</body>") == [("a", "body", 1), ("bc", "body", 1)]
    assert walk("<body>a<br/>b</body>") == [("a", "body", 1), ("b", "body", 1)]
    assert walk("<body>a<br>b<br/>c</body>") == [("a", "body", 1), ("b", "body", 1), ("c", "br", 2)]


def test_attributes(page):
    html = """<body><div ID=main class='a  b' itemprop>x</div><p title="class=no">y</p><p class="c" class="d&amp;e">z</p></body>"""
    rows = html_blocks(page(html)).orderBy("idx").collect()
    assert [(r["class"], r.id, r.itemprop) for r in rows] == [(["a", "b"], "main", ""), ([], "", ""), (["d&e"], "", "")]


def test_page_text(page):
    html = "<!DOCTYPE html><title>T</title><body><nav>Menu</nav> <p>A  <b>B</b>\n</p><style>no</style><template>no</template></body>"
    row = page_text(page_text(page(html), "document", out="doc"), "body").first()
    assert row.page_text == "menu a b"
    assert row.doc == "t menu   a   b \n"
    assert page_text(page("<p>x</p>"), "body").first().page_text == ""


def test_empty_pages(page):
    df = page("<body> </body>", "", None, "<body>x</body>")
    assert html_blocks(df).count() == 1
    kept = html_blocks(df, keep_empty_pages=True).orderBy("page_id").collect()
    assert [(r.page_id, r.idx) for r in kept] == [(0, None), (1, None), (2, None), (3, 0)]


def test_long_pages_come_in_batches(page):
    n = 10_000
    html = "<body>" + "".join(f"<p>{i}</p>" for i in range(n)) + "</body>"
    rows = html_blocks(page(html, html)).groupBy("page_id").agg(F.count("*").alias("n"), F.max("idx").alias("top"))
    assert [(r.n, r.top) for r in rows.collect()] == [(n, n - 1)] * 2


def test_blocks_do_not_depend_on_partitions(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    one = html_blocks(pages.coalesce(1)).collect()
    many = html_blocks(pages.repartition(13)).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, many))


def test_context_of_block_tables_equals_the_fold(spark):
    rules = SectionRules(ingredient=("the",), direction=("la",), headings=("h1", "p"))
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    folded = html_blocks(pages, rules=rules)
    tabled = block_context(html_blocks(pages), rules=rules, bucket=4)
    columns = ["page_id", "idx", "n_blocks", "section"]
    assert folded.select(*columns).exceptAll(tabled.select(*columns)).count() == 0
    assert folded.select(*columns).count() == tabled.count()
    assert folded.where("section is not null").count() > 0


def test_unreadable_pages(spark, page):
    from blockloom.operators.flatten import split_unreadable, unreadable_pages

    df = page("<body><p>a</p></body>", "<p>x</p><![ x [", None, "<p>b")
    assert [tuple(r) for r in unreadable_pages(df).collect()] == [(1, "Unreadable HTML")]
    assert {r.page_id for r in html_blocks(df).collect()} == {0, 3}
    # One walk: blocks as without the report, the skipped page beside them, an empty page as before.
    for options in ({}, {"rules": SectionRules()}, {"keep_empty_pages": True}):
        blocks, skipped = split_unreadable(html_blocks(df, report=True, **options))
        plain = html_blocks(df, **options).where("page_id <> 1")
        assert blocks.columns == plain.columns and blocks.exceptAll(plain).count() == plain.exceptAll(blocks).count() == 0
        assert [tuple(r) for r in skipped.collect()] == [(1, "Unreadable HTML")]
