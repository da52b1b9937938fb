"""A table of persons with known duplicates, derived from ``customer``.

The text below is valid for both Spark and DuckDB, so both see the same rows. Customer k
appears once as entered, and again in up to three altered forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinfold.operators.skew import in_small_tasks

# Names to choose from, as written and in plain letters.
_FIRST = [
    ("José", "Jose"), ("Anna", "Anna"), ("Müller", "Muller"), ("Abhay", "Abhay"),
    ("Zoë", "Zoe"), ("Martha", "Martha"), ("René", "Rene"), ("Stephen", "Stephen"),
    ("Priya", "Priya"), ("Søren", "Soren"), ("Catherine", "Catherine"), ("Wei", "Wei"),
    ("Aryan", "Aryan"), ("Michael", "Michael"), ("Ines", "Ines"), ("Thomas", "Thomas"),
    ("Fatima", "Fatima"),
]
_LAST = [
    ("García", "Garcia"), ("Smith", "Smith"), ("Groß", "Gross"), ("Pandey", "Pandey"),
    ("Schmidt", "Schmidt"), ("Nair", "Nair"), ("Wright", "Wright"), ("Núñez", "Nunez"),
    ("Gupta", "Gupta"), ("Thompson", "Thompson"), ("Kowalski", "Kowalski"),
    ("Lefèvre", "Lefevre"), ("Chen", "Chen"), ("Jørgensen", "Jorgensen"), ("Knight", "Knight"),
    ("Xavier", "Xavier"), ("O Neill", "O Neill"), ("Caesar", "Caesar"), ("Rossi", "Rossi"),
]

# Nation, latitude and longitude of its capital.
PLACES = [
    (0, 36.75, 3.06), (1, -34.60, -58.38), (2, -15.79, -47.88), (3, 45.42, -75.70), (4, 30.04, 31.24),
    (5, 9.03, 38.74), (6, 48.86, 2.35), (7, 52.52, 13.40), (8, 28.61, 77.21), (9, -6.21, 106.85),
    (10, 35.69, 51.39), (11, 33.31, 44.36), (12, 35.68, 139.69), (13, 31.95, 35.93), (14, -1.29, 36.82),
    (15, 34.02, -6.84), (16, -25.97, 32.57), (17, -12.05, -77.04), (18, 39.90, 116.41), (19, 44.43, 26.10),
    (20, 24.71, 46.68), (21, 21.03, 105.85), (22, 55.76, 37.62), (23, 51.51, -0.13), (24, 38.91, -77.04),
]


def _choose(number: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE CAST(({number}) % {len(values)} AS INT) {cases} END"


def _digits(number: str, width: int) -> str:
    return f"lpad(CAST({number} AS STRING), {width}, '0')"


_BASE = f"""
  SELECT k, v, n_name, r_name,
    {_choose('k', [a for a, _ in _FIRST])} AS first_written,
    {_choose('k', [b for _, b in _FIRST])} AS first_plain,
    {_choose('k * 7 + 3', [a for a, _ in _LAST])} AS last_written,
    {_choose('k * 7 + 3', [b for _, b in _LAST])} AS last_plain,
    {_digits('1950 + k * 13 % 55', 4)} AS yyyy,
    {_digits('1 + k * 5 % 12', 2)} AS mm,
    {_digits('1 + k * 11 % 28', 2)} AS dd,
    {_digits('(k * 7919 + 12345) % 1000000000', 9)} AS nine
  FROM forms JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
"""

PEOPLE_SQL = f"""
WITH forms AS (
  SELECT c_custkey AS k, c_nationkey, 0 AS v FROM customer
  UNION ALL SELECT c_custkey, c_nationkey, 1 FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey, c_nationkey, 2 FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, c_nationkey, 3 FROM customer WHERE c_custkey % 5 = 0
), base AS ({_BASE})
SELECT
  {_digits('k * 4 + v', 12)} AS unique_id,
  k AS entity_id,
  CASE v WHEN 0 THEN first_written || ' ' || last_written
         WHEN 1 THEN substr(first_plain, 1, 1) || '. ' || last_plain
         WHEN 2 THEN first_plain || ' ' || substr(last_plain, 1, 2) || substr(last_plain, 4, 20)
         ELSE CASE WHEN k % 10 = 0 THEN first_plain ELSE last_plain || '  ' || first_plain END
    END AS full_name,
  CASE v WHEN 0 THEN lower(first_plain) || '.' || replace(lower(last_plain), ' ', '')
                     || CAST(k AS STRING) || '@example.com'
         WHEN 1 THEN lower(first_plain) || '.' || replace(lower(last_plain), ' ', '')
                     || CAST(k AS STRING) || '@mail.example.org'
         WHEN 2 THEN CASE WHEN k % 9 = 0 THEN NULL ELSE ' ' || upper(first_plain) || '.'
                     || replace(upper(last_plain), ' ', '') || CAST(k AS STRING)
                     || '@EXAMPLE.COM' END
         ELSE lower(first_plain) || replace(lower(last_plain), ' ', '')
                     || CAST(k AS STRING) || '@example.com' END AS email,
  CASE v WHEN 0 THEN '9' || nine
         WHEN 1 THEN '+91-9' || nine
         WHEN 2 THEN '9' || substr(nine, 1, 4) || ' ' || substr(nine, 5, 5)
         ELSE CASE WHEN k % 20 = 5 THEN 'n/a'
              ELSE '9' || substr(nine, 1, 2) || '-' || substr(nine, 3, 3) || '-'
                   || substr(nine, 6, 4) END END AS phone,
  CASE v WHEN 0 THEN yyyy || '-' || mm || '-' || dd
         WHEN 1 THEN dd || '/' || mm || '/' || yyyy
         WHEN 2 THEN yyyy || '.' || mm || '.' || dd
         ELSE yyyy || '/' || mm || '/' || dd END AS date_of_birth,
  CASE v WHEN 2 THEN CAST(1 + k % 300 AS STRING) || ', Hill Rd'
         ELSE CAST(1 + k % 300 AS STRING) || ' Hill Road' END AS address,
  CASE v WHEN 1 THEN substr(n_name, 1, 2) || substr(n_name, 4, 30) ELSE n_name END AS city,
  CASE v WHEN 3 THEN lower(r_name) ELSE r_name END AS state,
  CASE v WHEN 2 THEN '4' || {_digits('k * 31 % 100', 2)} || ' ' || {_digits('k % 500', 3)}
         ELSE '4' || {_digits('k * 31 % 100', 2)} || {_digits('k % 500', 3)} END AS postal_code,
  CASE v WHEN 0 THEN 'https://www.site' || CAST(k % 700 AS STRING) || '.example.com/home'
         ELSE 'http://Site' || CAST(k % 700 AS STRING) || '.example.com/p?v=1' END AS website
FROM base
"""

TABLES = ("customer", "nation", "region", "supplier")


def people(spark: SparkSession, folder: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in ("customer", "nation", "region")}
    # a record is some twenty expressions long, so a small file is already many rows to derive from
    tables["customer"] = in_small_tasks(tables["customer"], 20)
    sql = PEOPLE_SQL
    for name in tables:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return spark.sql(sql, **tables)
