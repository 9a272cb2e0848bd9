"""Structured features of blocks, all built-in expressions in one projection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.text import any_of, count_char, count_digits, digit, whole_word
from blockloom.operators.flatten import DIRECTION_KEYWORDS, INGREDIENT_KEYWORDS
from blockloom.operators.sections import position_ratio

# Measurement units.
UNITS = (
    "teaspoon", "teaspoons", "tsp", "tablespoon", "tablespoons", "tbsp",
    "cup", "cups", "ounce", "ounces", "oz", "pound", "pounds", "lb", "lbs",
    "gram", "grams", "g", "kilogram", "kilograms", "kg", "liter", "liters", "l",
    "ml", "milliliter", "milliliters", "pinch", "clove", "cloves", "slice", "slices",
)
# Number words that count as a quantity. "one" and the two-thirds
# sign do not (fix_quantity adds them).
QUANTITY_WORDS = ("two", "three", "four", "five")
QUANTITY_SIGNS = "½¼¾⅓"

# Names of the structured features.
STRUCTURED = (
    "tag", "depth", "text_len", "starts_with_digit", "parent_tag", "num_digits",
    "contains_unit", "comma_count", "dot_count", "contains_quantity_number",
    "element_index", "position_ratio", "is_under_current_ingredient_section",
    "is_under_current_direction_section", "class_has_ing_keyword",
    "class_has_dir_keyword", "class_has_title_keyword",
)


@dataclass(frozen=True)
class FeatureRules:
    ingredient: tuple[str, ...] = INGREDIENT_KEYWORDS
    direction: tuple[str, ...] = DIRECTION_KEYWORDS
    # Default keywords of a title's class and id.
    title: tuple[str, ...] = ("title", "name", "headline")
    units: tuple[str, ...] = field(default=UNITS)
    fix_quantity: bool = False


def quantity_number(text: Column, fix: bool = False) -> Column:
    words = (("one",) + QUANTITY_WORDS) if fix else QUANTITY_WORDS
    signs = QUANTITY_SIGNS + ("⅔" if fix else "")
    return text.rlike(rf"[\p{{Nd}}{signs}]") | text.rlike(whole_word(words))


def block_features(blocks: DataFrame, rules: FeatureRules = FeatureRules()) -> DataFrame:
    """Add the structured features and raw to blocks with idx, n_blocks and section."""
    t = F.col("text")
    class_id = F.lower(F.concat(F.array_join("class", " "), F.lit(" "), F.col("id")))
    computed = {
        "text_len": F.char_length(t),
        "starts_with_digit": t.rlike(f"^(?:{digit()})"),
        "parent_tag": F.lit("None"),
        "raw": t,
        "num_digits": count_digits(t),
        "contains_unit": F.lower(t).rlike(whole_word(rules.units)).cast("int"),
        "comma_count": count_char(t, ","),
        "dot_count": count_char(t, "."),
        "contains_quantity_number": quantity_number(t, rules.fix_quantity).cast("int"),
        "element_index": F.col("idx"),
        "position_ratio": position_ratio(),
        "is_under_current_ingredient_section": F.coalesce(
            (F.col("section") == "ingredient").cast("int"), F.lit(0)
        ),
        "is_under_current_direction_section": F.coalesce(
            (F.col("section") == "direction").cast("int"), F.lit(0)
        ),
        "class_has_ing_keyword": class_id.rlike(any_of(rules.ingredient)).cast("int"),
        "class_has_dir_keyword": class_id.rlike(any_of(rules.direction)).cast("int"),
        "class_has_title_keyword": class_id.rlike(any_of(rules.title)).cast("int"),
    }
    return blocks.select("*", *[c.alias(n) for n, c in computed.items()])


def dict_vectorize(features: DataFrame, keys: list[str], columns: tuple[str, ...] = STRUCTURED) -> DataFrame:
    """Long form (keys..., key, value): strings become one-hot "name=value", the rest numbers."""
    types = dict(features.dtypes)
    entries = [
        F.struct(
            (F.concat(F.lit(f"{c}="), F.col(c)) if types[c] == "string" else F.lit(c)).alias("key"),
            (F.lit(1.0) if types[c] == "string" else F.col(c).cast("double")).alias("value"),
        )
        for c in columns
    ]
    return features.select(*keys, F.inline(F.array(*entries)))
