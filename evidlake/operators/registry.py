"""Registry values to artefact families.

Input: one row per value (host, hive, key_path, value_name, value_type, value_text,
value_data). A family is a filter on the key path and a projection. Families that
read several values of one key fold them with conditional aggregates over
(host, hive, key): a key is a handful of values, and rows are dealt out by key, so a
host with a third of the rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.catalogs import lookups as L
from evidlake.functions.binary import le_number, utf16_text
from evidlake.functions.text import lookup
from evidlake.functions.times import filetime

ROT13_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ROT13_TO = "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"


def rot13(text: Column) -> Column:
    return F.translate(text, ROT13_FROM, ROT13_TO)


def _key_is(path: str) -> Column:
    return F.lower("key_path") == path.lower()


def _under(path: str) -> Column:
    return F.startswith(F.lower("key_path"), F.lit(path.lower() + "\\"))


def _part(path: str, number: int) -> Column:
    """The n-th key name below a base path (1-based)."""
    below = F.expr(f"substring(key_path, {len(path) + 2})")
    return F.split_part(below, F.lit("\\"), F.lit(number))


def userassist(values: DataFrame) -> DataFrame:
    data = F.col("value_data")
    size = F.octet_length(data)
    rows = values.filter((F.col("hive") == "HKCU") & _under(L.USERASSIST_KEY))
    return rows.filter(_part(L.USERASSIST_KEY, 2) == "Count").select(
        "host",
        rot13(F.col("value_name")).alias("program"),
        _part(L.USERASSIST_KEY, 1).alias("guid"),
        F.when(size >= 8, le_number(data, 4, 4)).otherwise(F.lit(0)).alias("run_count"),
        F.when(size >= 72, filetime(le_number(data, 60, 8))).alias("last_executed"),
    )


def _run_location() -> Column:
    location = F.lit(None).cast("string")
    for (hive, path), label in L.RUN_KEYS.items():
        location = F.when((F.col("hive") == hive) & _key_is(path), label).otherwise(location)
    return location


def run_keys(values: DataFrame) -> DataFrame:
    return (
        values.withColumn("location", _run_location())
        .filter(F.col("location").isNotNull())
        .select(
            "host", "location", F.col("value_name").alias("name"),
            F.col("value_text").alias("command"), F.col("value_type").alias("type"),
        )
    )


def recent_docs(values: DataFrame) -> DataFrame:
    rows = values.filter(
        (F.col("hive") == "HKCU") & _key_is(L.RECENT_DOCS_KEY)
        & (F.col("value_name") != "") & (F.octet_length("value_data") > 0)
    )
    rows = rows.select("host", utf16_text(F.col("value_data")).alias("filename"))
    return rows.filter(F.col("filename") != "")


def typed_urls(values: DataFrame) -> DataFrame:
    return values.filter(
        (F.col("hive") == "HKCU") & _key_is(L.TYPED_URLS_KEY) & (F.col("value_text") != "")
    ).select("host", F.col("value_text").alias("url"), F.col("value_name").alias("position"))


def _is_mru() -> Column:
    return F.lower("key_path").isin([k.lower() for k in L.MRU_KEYS])


def mru_lists(values: DataFrame) -> DataFrame:
    rows = values.filter(
        (F.col("hive") == "HKCU") & _is_mru()
        & (F.col("value_name") != "MRUListEx") & (F.octet_length("value_data") > 0)
    )
    rows = rows.select(
        "host",
        utf16_text(F.col("value_data")).alias("path"),
        F.substring_index("key_path", "\\", -1).alias("type"),
    )
    return rows.filter(F.col("path") != "")


def _fold(values: DataFrame, names: list[str], **keys: Column) -> DataFrame:
    """One row per key with the named values as columns.

    Folding text sorts the rows of a task, so they are dealt out by key first: however many
    rows one input task yields, none of them waits there in memory.
    """
    values = values.select("host", "hive", "key_path", "value_name", "value_text")
    values = values.repartition("host", "hive", "key_path")
    aggregates = [
        F.max(F.when(F.col("value_name") == n, F.col("value_text"))).alias(n) for n in names
    ]
    grouping = [c.alias(k) for k, c in keys.items()]
    return values.groupBy("host", "hive", "key_path", *grouping).agg(*aggregates)


def usb_devices(values: DataFrame) -> DataFrame:
    rows = values.filter((F.col("hive") == "HKLM") & _under(L.USBSTOR_KEY))
    device, serial = _part(L.USBSTOR_KEY, 1), _part(L.USBSTOR_KEY, 2)
    folded = _fold(rows.filter(serial != ""), ["FriendlyName", "Service"], device=device, serial=serial)
    return folded.select(
        "host",
        F.coalesce("FriendlyName", "device").alias("device"),
        "serial",
        F.col("device").alias("type"),
        F.coalesce("Service", F.lit("")).alias("service"),
    )


def installed_programs(values: DataFrame) -> DataFrame:
    guid = F.substring_index("key_path", "\\", -1)
    wanted = F.lit(False)
    for hive, path in L.UNINSTALL_KEYS:
        wanted = wanted | ((F.col("hive") == hive) & _under(path))
    names = ["DisplayName", "Publisher", "DisplayVersion", "InstallDate"]
    folded = _fold(values.filter(wanted), names, guid=guid)
    return folded.filter(F.coalesce("DisplayName", F.lit("")) != "").select(
        "host",
        F.col("DisplayName").alias("name"),
        F.coalesce("Publisher", F.lit("")).alias("publisher"),
        F.coalesce("DisplayVersion", F.lit("")).alias("version"),
        F.coalesce("InstallDate", F.lit("")).alias("install_date"),
        "guid",
    )


def network_profiles(values: DataFrame) -> DataFrame:
    rows = values.filter((F.col("hive") == "HKLM") & _under(L.NETWORK_PROFILES_KEY))
    folded = _fold(
        rows, ["ProfileName", "Description", "Managed"], guid=_part(L.NETWORK_PROFILES_KEY, 1)
    )
    return folded.filter(F.coalesce("ProfileName", F.lit("")) != "").select(
        "host",
        F.col("ProfileName").alias("name"),
        F.coalesce("Description", F.lit("")).alias("description"),
        F.coalesce("Managed", F.lit("")).alias("managed"),
        "guid",
    )


def start_type(code: Column) -> Column:
    return F.when(code.isNull(), "").otherwise(
        lookup(L.SERVICE_START, code.try_cast("int"), F.lit("Unknown"))
    )


def services(values: DataFrame) -> DataFrame:
    rows = values.filter((F.col("hive") == "HKLM") & _under(L.SERVICES_KEY))
    folded = _fold(rows, ["DisplayName", "ImagePath", "Start"], name=_part(L.SERVICES_KEY, 1))
    return folded.filter(F.coalesce("ImagePath", F.lit("")) != "").select(
        "host",
        "name",
        F.coalesce("DisplayName", "name").alias("display_name"),
        F.col("ImagePath").alias("image_path"),
        start_type(F.col("Start")).alias("start_type"),
    )


def auto_start(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("start_type").isin("Automatic", "Boot", "System"))


FAMILIES = {
    "userassist": userassist,
    "run_keys": run_keys,
    "recent_docs": recent_docs,
    "usb_devices": usb_devices,
    "typed_urls": typed_urls,
    "installed_programs": installed_programs,
    "network_profiles": network_profiles,
    "mru_lists": mru_lists,
    "services": services,
}


def registry_statistics(values: DataFrame) -> DataFrame:
    """Artefacts per family and in total, in two passes over the values.

    Families of single values are counted as they stand. Families of keys count the
    distinct keys that hold the value which makes them an artefact.
    """
    data = F.octet_length("value_data") > 0
    hkcu = F.col("hive") == "HKCU"
    kind = (
        F.when(hkcu & _under(L.USERASSIST_KEY) & (_part(L.USERASSIST_KEY, 2) == "Count"), "userassist")
        .when(_run_location().isNotNull(), "run_keys")
        .when(
            hkcu & _key_is(L.RECENT_DOCS_KEY) & (F.col("value_name") != "") & data
            & (utf16_text(F.col("value_data")) != ""),
            "recent_docs",
        )
        .when(hkcu & _key_is(L.TYPED_URLS_KEY) & (F.col("value_text") != ""), "typed_urls")
        .when(
            hkcu & _is_mru() & (F.col("value_name") != "MRUListEx") & data
            & (utf16_text(F.col("value_data")) != ""),
            "mru_lists",
        )
    )
    single = values.select(kind.alias("family")).filter(F.col("family").isNotNull())
    text = F.coalesce("value_text", F.lit("")) != ""
    hklm = F.col("hive") == "HKLM"
    uninstall = F.lit(False)
    for hive, path in L.UNINSTALL_KEYS:
        uninstall = uninstall | ((F.col("hive") == hive) & _under(path))
    named = lambda name: (F.col("value_name") == name) & text
    keyed = (
        F.when(hklm & _under(L.USBSTOR_KEY) & (_part(L.USBSTOR_KEY, 2) != ""), "usb_devices")
        .when(uninstall & named("DisplayName"), "installed_programs")
        .when(hklm & _under(L.NETWORK_PROFILES_KEY) & named("ProfileName"), "network_profiles")
        .when(hklm & _under(L.SERVICES_KEY) & named("ImagePath"), "services")
    )
    keys = (
        values.select(keyed.alias("family"), "host", "hive", "key_path")
        .filter(F.col("family").isNotNull())
        .distinct()
        .select("family")
    )
    counted = single.unionByName(keys).groupBy("family").agg(F.count("*").alias("n"))
    every = values.sparkSession.createDataFrame([(f, 0) for f in FAMILIES], "family string, n long")
    return counted.unionByName(every).rollup("family").agg(F.sum("n").alias("artifacts")).select(
        F.coalesce("family", F.lit("total")).alias("family"), "artifacts"
    )


def most_run_programs(values: DataFrame, n: int = 100) -> DataFrame:
    return userassist(values).orderBy(F.desc("run_count"), "host", "program").limit(n)


def programs_by_name(values: DataFrame) -> DataFrame:
    return installed_programs(values).orderBy(F.lower("name"), "host", "guid")
