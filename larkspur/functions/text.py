"""Text, brand, category and semantic functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and lookup tables that results depend on.
FILLERS = ["krazee", "jumbo", "promo", "free", "new", "nispc", "special", "offer", "combo", "value", "mega", "family"]
UNIT_WORDS = ["gm", "kg", "g", "kgs", "gms", "lb", "lbs", "oz", "ml", "l"]
CATEGORY_WORDS = {
    "Chicken": ["chicken"],
    "Meat": ["beef", "veal", "lamb", "mutton", "kofta", "kibbeh"],
    "Seafood": ["fish", "shrimp", "shrimps", "prawn", "prawns", "seafood", "dori", "tilapia", "salmon"],
    "Veg": ["vegetable", "vegetables", "veg", "peas", "corn", "spinach"],
    "Potato": ["potato", "potatoes", "fries", "wedges"],
    "Fruits": ["fruit", "fruits", "berry", "berries", "strawberry", "mango"],
    "Dough": ["paratha", "tortilla", "flour", "dough", "samosa", "wrap", "wraps"],
}
CATEGORY_OF_GROUP = {
    "Chicken": "Chicken", "Chicken-Mince": "Chicken", "Chicken-Commodity": "Chicken", "Chicken-ZNG": "Chicken",
    "Meat": "Meat", "Meat-Commodity": "Meat",
    "Seafood": "Seafood", "Seafood-ZING": "Seafood", "Seafood-Commodity": "Seafood",
    "Fruits": "Fruits", "Veg": "Veg",
    "Potato": "Potato", "Potato-Commodity": "Potato", "Potato-Spl": "Potato",
    "Dough": "Dough",
}
PLURALS = {
    "nugget": "nuggets", "burger": "burgers", "patty": "patties", "sausage": "sausages", "strip": "strips", "wing": "wings",
    "prawn": "prawns", "shrimp": "shrimps", "paratha": "parathas", "samosa": "samosas", "roll": "rolls",
}
PROTEINS = ["chicken", "beef", "veal", "lamb", "mutton", "fish", "shrimp", "shrimps", "prawn", "prawns", "turkey"]
NON_MEAT = ["cheese", "chocolate", "vegetable", "vegetables", "veg", "peas", "corn", "potato", "potatoes", "fries", "paratha", "spinach"]
FAMILIES = [
    "seekh kebab", "spring roll", "chicken fries", "fish fingers", "cheese sticks", "chicken strips", "chicken fillet",
    "chicken fillets", "chicken popcorn", "chicken nuggets", "beef burger", "chicken burger", "burger", "burgers",
    "nuggets", "fillet", "fillets", "strips", "popcorn", "kibbeh", "kofta", "samosa", "samosas", "paratha", "fries",
    "wedges", "patties", "sausages", "shrimps", "prawns",
]
VARIANTS = ["spicy", "non spicy", "regular", "hot", "sriracha", "buffalo", "bbq", "barbecue", "onion", "breaded", "zing", "krazee", "jumbo", "mild"]


def words_of(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def safe(c: Column | str) -> Column:
    """Text, with null as empty."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def single_spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def letters(c: Column) -> Column:
    """Runs of the letters a to z of lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))


def normalized_brand(c: Column) -> Column:
    """Lower case; runs of white space and hyphens become a space; then other signs go."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(safe(c)), r"(?U)[\s\-]+", " ")), "[^a-z0-9 ]", "")


def clean_offer(c: Column, own_brand: str | None = None) -> Column:
    """Words of an offer without the own brand (a pattern), filler words and units."""
    text = F.lower(safe(c))
    if own_brand:
        text = F.regexp_replace(text, own_brand, " ")
    return F.array_join(F.filter(letters(text), lambda w: ~w.isin(*FILLERS, *UNIT_WORDS)), " ")


def category(c: Column) -> Column:
    """First rule with a whole-word hit; the phrase `spring roll` goes before all rules."""
    text, found = F.lower(safe(c)), letters(safe(c))
    out = F.when(text.contains("spring roll"), "Dough")
    for name, words in CATEGORY_WORDS.items():
        out = out.when(F.arrays_overlap(found, words_of(words)), name)
    return out.otherwise("Other")


def master_category(c: Column) -> Column:
    return F.coalesce(F.element_at(table(CATEGORY_OF_GROUP), safe(c)), category(c))


def product_family(c: Column) -> Column:
    """Product without the word frozen, in letters and digits, each word in its listed plural."""
    text = F.regexp_replace(F.regexp_replace(F.lower(safe(c)), r"(?U)\bfrozen\b", " "), "[^a-z0-9]+", " ")
    plural = table(PLURALS)
    return F.array_join(F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: F.coalesce(F.element_at(plural, w), w)), " ")


def offer_match_text(name: Column, product: Column, variant: Column, own_brand: str | None = None) -> Column:
    low = F.lower(safe(variant))
    extra = F.when(low.isin("no variant", ""), "").otherwise(low)
    return single_spaced(F.concat_ws(" ", clean_offer(name, own_brand), F.replace(F.lower(safe(product)), F.lit("-frozen"), F.lit("")), extra))


def master_match_text(name: Column, group: Column, description: Column) -> Column:
    return single_spaced(F.concat_ws(" ", *(F.lower(safe(c)) for c in (name, group, description))))


def identity_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(safe(c), r"(?U)^\s+|\s+$", "")), r"(?U)\s+", " ")


def itemcode(c: Column) -> Column:
    """Without one trailing `.0` and outer blanks; leading zeros stay; blank becomes null."""
    return F.nullif(F.trim(F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")), F.lit(""))


def short_number(c: Column) -> Column:
    """A number with at most six significant digits and no trailing zeros; exact halves of the binary
    value decide, which decimal rounding inside the JVM would miss."""

    @F.pandas_udf("string")
    def shown(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else f"{v:g}")

    return shown(c)


def offer_display(name: Column, retailer: Column, price: Column, currency: str = "SAR") -> Column:
    shown = F.when(price.isNull(), "N/A").otherwise(F.concat(F.lit(currency + " "), short_number(price)))
    return F.concat_ws(" — ", single_spaced(safe(name)), single_spaced(safe(retailer)), shown)


def sku_label(code: Column, name: Column) -> Column:
    return F.concat_ws(" - ", safe(code), safe(name))


def retail_unit(measures: Column) -> Column:
    """Smallest single measure as `270g` or `500ml`; empty if there is none."""
    one = F.array_min(F.filter(measures, lambda m: m["c"] == 1))
    return F.coalesce(F.concat(F.bround(one["v"], 0).cast("bigint").cast("string"), F.when(one["d"] == "weight", "g").otherwise("ml")), F.lit(""))


def pair_label(c: Column) -> Column:
    """An exact whole number, else null; true and false are no numbers."""
    number = F.trim(c.cast("string")).try_cast("double")
    return F.when(number == F.floor(number), number.cast("int"))


def training_flag(c: Column) -> Column:
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin("1", "1.0", "true", "yes"), 1).when(low.isin("0", "0.0", "false", "no"), 0)


def synthetic(*columns: Column) -> Column:
    return F.lower(F.concat_ws(" ", *map(safe, columns))).contains("synthetic")


def proteins(c: Column) -> Column:
    return F.array_intersect(letters(safe(c)), words_of(PROTEINS))


def phrases(c: Column, known: list[str]) -> Column:
    """Phrases of a list that stand in the text between word borders."""
    text = F.concat(F.lit(" "), F.regexp_replace(F.lower(safe(c)), "[^a-z0-9]+", " "), F.lit(" "))
    return F.filter(words_of(known), lambda p: F.contains(text, F.concat(F.lit(" "), p, F.lit(" "))))


def families(c: Column) -> Column:
    return phrases(c, FAMILIES)


def variants(c: Column) -> Column:
    return phrases(c, VARIANTS)


def agree(a: Column, b: Column) -> Column:
    """1 if either side is empty or they share a value, else 0."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 1).otherwise(F.arrays_overlap(a, b).cast("int"))


def has_non_meat(c: Column) -> Column:
    return F.arrays_overlap(letters(safe(c)), words_of(NON_MEAT)).cast("int")


def expected_matches(c: Column) -> Column:
    """Separators between blanks, plus one, from 1 to 4."""
    return F.least(F.lit(4), F.regexp_count(F.lower(safe(c)), F.lit(r"(?U)\s(?:/|\bor\b|\band\b|\+)\s")) + 1).cast("double")
