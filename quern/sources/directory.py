"""Directory lists: people of a municipality in blocks of at most forty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import col

# They decide results and are stated as given.
BLOCK = 40
HOMOGLYPHS = ("ABCEHJKMOPTXY", "АВСЕНЈКМОРТХУ")
TRANSLITERATION = {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "ѓ": "gj", "е": "e", "ж": "zh", "з": "z", "ѕ": "dz", "и": "i", "ј": "j", "к": "k", "л": "l", "љ": "lj", "м": "m", "н": "n", "њ": "nj", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "ќ": "kj", "у": "u", "ф": "f", "х": "h", "ц": "c", "ч": "ch", "џ": "dj", "ш": "sh"}


def same_letters(text: Column | str) -> Column:
    """Latin capitals that look Cyrillic become Cyrillic."""
    return F.translate(col(text), *HOMOGLYPHS)


def without_formula(text: Column | str) -> Column:
    """Without a cell range that leaked into the text; the pattern is a fixed value."""
    return F.regexp_replace(col(text), r"\s*\+\s*\$?[A-Z]+\$?\d+\s*:\s*\$?[A-Z]+\$?\d+\s*$", "")


def clean_cell(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(without_formula(F.coalesce(col(text), F.lit(""))), "(?U)\\s+", " "))


#: How the columns are headed, by their beginnings.
HEADINGS = {"municipality": "општина", "name": "име", "address": "адреса", "place": "место", "phone": "телефон"}


def located(cells: DataFrame, headings: dict[str, str] = HEADINGS, key: str = "municipality", needed: str = "name") -> tuple[DataFrame, DataFrame]:
    """(file, row, columns of headings) below each file's header, and files without one.

    cells are (file, row, cells array<string>), as sheets give them.  Rows without
    any text are none.  The header is the first row with a cell that begins like
    the key's heading and one that begins like the needed one's; each column is
    where its heading stands, so shifted and reordered columns are read right, and
    a heading that is missing gives null.  Rows without key or needed value go.
    """
    clean = F.transform("cells", clean_cell)
    rows = cells.select("file", "row", clean.alias("cells")).where(F.exists("cells", lambda c: c != ""))
    low = F.transform("cells", lambda c: F.lower(c))

    def place(heading: str) -> Column:
        return F.array_position(F.transform(low, lambda c: F.startswith(c, F.lit(heading))), True)

    places = F.struct(*[place(heading).alias(name) for name, heading in headings.items()])
    heads = rows.withColumn("at", places).where((F.col(f"at.{key}") > 0) & (F.col(f"at.{needed}") > 0)).groupBy("file").agg(F.min(F.struct("row", "at")).alias("head"))
    value = lambda n: F.when(F.col(f"head.at.{n}") > 0, F.get("cells", (F.col(f"head.at.{n}") - 1).cast("int"))).alias(n)
    below = rows.join(heads, "file").where(F.col("row") > F.col("head.row")).select("file", "row", *map(value, headings))
    below = below.withColumn(key, same_letters(F.upper(without_formula(key))))
    told = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return below.where(told(key) & told(needed)), cells.select("file").distinct().join(heads, "file", "left_anti")


def slug(text: Column | str) -> Column:
    """Latin letters and digits; other runs are one underscore, none at the ends."""
    t = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), TRANSLITERATION.items(), F.lower(F.trim(col(text))))
    t = F.regexp_replace(F.regexp_replace(t, "[^\\p{L}\\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(t == "", "unknown").otherwise(t)


def line(name: Column, address: Column, place: Column, municipality: Column, phone: Column, words: tuple[str, str, str, str] = ("адреса", "место", "телефон", "не е наведен")) -> Column:
    """Name, and what is known; a place that is the municipality isn't repeated."""
    told = lambda c: c.isNotNull() & (c != "")
    return F.concat_ws(
        " | ", name,
        F.when(told(address), F.concat(F.lit(f"{words[0]}: "), address)),
        F.when(told(place) & (F.upper(place) != F.upper(municipality)), F.concat(F.lit(f"{words[1]}: "), place)),
        F.concat(F.lit(f"{words[2]}: "), F.when(told(phone), phone).otherwise(words[3])),
    )


def parts(agents: DataFrame, by: list[str], name: str = "name", tie: str | None = None, size: int = BLOCK) -> DataFrame:
    """agents with n_agents, number, part and n_parts within their group, sorted by name."""
    group = Window.partitionBy(*by)
    numbered = agents.withColumn("number", F.row_number().over(group.orderBy(name, *([tie] if tie else [])))).withColumn("n_agents", F.count("*").over(group))
    return numbered.withColumn("part", F.floor((F.col("number") - 1) / size) + 1).withColumn("n_parts", F.ceil(F.col("n_agents") / size))


def blocks(agents: DataFrame, list_key: str, by: str = "municipality", size: int = BLOCK) -> DataFrame:
    """One block a part: header with range and true total, then the lines; at most `size` lines meet."""
    p = parts(agents, [by], size=size)
    lines = F.array_sort(F.collect_list(F.struct("number", F.concat(F.col("number").cast("string"), F.lit(". "), F.col("line")).alias("l"))))
    made = p.groupBy(by, "part", "n_parts", "n_agents").agg(F.min("number").alias("first"), F.max("number").alias("last"), lines.alias("lines"))
    head = F.concat_ws(" ", F.format_string("%s: %d.", by, "n_agents"), F.when(F.col("n_parts") > 1, F.format_string("%d/%d (%d-%d).", "part", "n_parts", "first", "last")))
    body = F.array_join(F.transform("lines", lambda x: x["l"]), "\n")
    return made.select(F.concat(F.lit(f"agents_{list_key}_"), slug(by), F.lit("_p"), F.col("part").cast("string")).alias("chunk_id"), F.lit(list_key).alias("list_key"), F.col(by).alias("municipality"), "n_agents", "part", "n_parts", "first", "last", F.concat_ws("\n", head, body).alias("content"))
