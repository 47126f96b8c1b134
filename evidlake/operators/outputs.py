"""Captured command output to rows, in one pass.

Each output gets a format, is cut into sections and lines, and each line becomes an
array of (name, value) fields. Section headers come from splitting the text in front
of them, so nothing looks back over lines: no window, no shuffle, and an output of
any size stays in the task that read it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.catalogs import lookups as L
from evidlake.functions.rows import once
from evidlake.functions.text import after_colon, any_contains, before_colon, lookup

FIELDS = "array<struct<name:string,value:string>>"

# Column names of a user list whose own header cannot be read.
USER_COLUMNS = [
    "AccountType", "Description", "Disabled", "Domain", "FullName", "LocalAccount", "Lockout",
    "Name", "PasswordChangeable", "PasswordExpires",
]

# Field names of the columns of a task list; others keep their heading.
TASK_COLUMNS = {"Image Name": "name", "PID": "pid", "Session Name": "session", "Mem Usage": "mem"}

# Where a section starts, per format: at the beginning of a line that looks like this.
SECTION_START = {
    "ipconfig": r"\S",
    "format_list": r"(?!\s*===)(?=[^\n]*\S)[^:\n]*$",
    "netstat_statistics": r"(?=[^\s\n])(?![^\n]{0,9}\d)",
    "arp": r"[^\n]*Interface:",
    "route": r"[^\n]*Destination",
    "sc_query": r"\s*SERVICE_NAME",
    "usb": r"[^\n]*=== USB (?:DEVICE INFO|INSERT / REMOVE EVENTS) ===",
}


def clean_output(output: Column) -> Column:
    """Line ends as \\n, no blank space around the text."""
    text = F.regexp_replace(output, "\r\n?", "\n")
    return F.regexp_replace(text, r"(?U)^\s+|(?<!\s)\s++\z", "")


def usable(outputs: DataFrame) -> DataFrame:
    """Non-empty output that is not an error message."""
    text = F.col("output")
    return outputs.filter(
        text.isNotNull() & text.rlike(r"(?U)\S") & ~F.startswith(text, F.lit("[ERROR]"))
    )


def collected(outputs: DataFrame) -> DataFrame:
    """Without the categories that only ask for an analysis."""
    return outputs.filter(~F.col("category").isin(L.ANALYSIS_CATEGORIES))


def describe(outputs: DataFrame) -> DataFrame:
    """Description of each command, or its first 100 characters."""
    return outputs.withColumn(
        "description",
        lookup(L.COMMAND_DESCRIPTIONS, F.col("cmd"), F.substring("cmd", 1, 100)),
    )


def evidence_blocks(outputs: DataFrame) -> DataFrame:
    """Usable output as text blocks with their heading, one block per command."""
    head = F.concat(
        F.lit("=== "), F.upper("category"), F.lit(" - "), F.substring("cmd", 1, 80), F.lit(" ===\n")
    )
    rows = usable(collected(outputs))
    return rows.select("host", "category", "cmd", F.concat(head, "output").alias("text"))


def shell_type(os: Column, cmd: Column) -> Column:
    """Which shell a command is for."""
    words = [w.lower() for w in L.POWERSHELL_WORDS]
    powershell = any_contains(F.lower(cmd), words) | cmd.rlike(r"\$\w+")
    analysis = F.startswith(cmd, F.lit("ANALYZE_")) | F.startswith(cmd, F.lit("HASH_"))
    return (
        F.when(analysis & F.contains(cmd, F.lit("ANALYZE")), "regex_analysis")
        .when(analysis, "hash_analysis")
        .when(os == "linux", "bash")
        .when(os == "macos", "zsh")
        .when(powershell, "powershell")
        .otherwise("cmd")
    )


def output_format(cmd: Column, text: Column) -> Column:
    """First of fifteen rules that fits."""
    command = F.lower(cmd)
    has = lambda word: F.contains(command, F.lit(word))
    inside = lambda word: F.contains(text, F.lit(word))
    lines = F.split(text, "\n")
    dashed = F.exists(F.slice(lines, 1, 10), lambda l: F.contains(l, F.lit("---")))
    colons = F.size(F.filter(lines, lambda l: F.contains(l, F.lit(":"))))
    many_colons = colons > F.size(lines) * 0.3
    statistics = has("-e") | has("-s") | F.contains(F.lower(text), F.lit("statistics"))
    listing = has("format-list") | (has("get-") & inside(":") & ~has("format-table"))
    return (
        F.when(has("systeminfo") & inside(":"), "key_value")
        .when(has("net user") & inside("User accounts for"), "net_user")
        .when(has("wmic") & has("useraccount"), "wmic")
        .when(has("tasklist"), "tasklist")
        .when(listing, "format_list")
        .when(dashed, "dashed_table")
        .when(has("netstat") & statistics, "netstat_statistics")
        .when(has("netstat") & (inside("TCP") | inside("UDP")), "netstat")
        .when(has("arp"), "arp")
        .when(has("ipconfig"), "ipconfig")
        .when(has("route print"), "route")
        .when(has("sc query") | has("sc.exe query"), "sc_query")
        .when(inside("==="), "usb")
        .when(inside(":") & many_colons, "generic_key_value")
        .otherwise("generic")
    )


def _first_line(lines: Column, test) -> Column:
    """0-based number of the first line that passes, NULL when none does."""
    at = F.array_position(F.transform(lines, test), True) - 1
    return F.when(at >= 0, at.cast("int"))


def _sections(fmt: Column, body: Column) -> Column:
    out = None
    for name, start in SECTION_START.items():
        parts = F.split(body, rf"(?m)^(?={start})")
        out = F.when(fmt == name, parts) if out is None else out.when(fmt == name, parts)
    return out.otherwise(F.array(body))


def _is_header(fmt: Column, line: Column) -> Column:
    out = None
    for name, start in SECTION_START.items():
        hit = line.rlike(rf"(?m)^(?:{start})")
        out = F.when(fmt == name, hit) if out is None else out.when(fmt == name, hit)
    return F.coalesce(out, F.lit(False))


def _section_name(fmt: Column, header: Column) -> Column:
    return (
        F.when(fmt == "ipconfig", F.regexp_replace(F.trim(header), ":+$", ""))
        .when(fmt == "sc_query", after_colon(header))
        .when(fmt == "usb", F.when(F.contains(header, F.lit("DEVICE INFO")), "device").otherwise("event"))
        .otherwise(F.trim(header))
    )


def _fields(**values: Column) -> Column:
    return F.array(
        *[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in values.items()]
    )


def _pair(key: Column, value: Column) -> Column:
    return F.array(F.struct(key.alias("name"), value.alias("value")))


def _cells(parts: Column, headers: Column) -> Column:
    return F.transform(
        parts,
        lambda cell, i: F.struct(
            F.coalesce(F.try_element_at(headers, i + 1), F.concat(F.lit("column_"), (i + 1).cast("string"))).alias("name"),
            cell.alias("value"),
        ),
    )


def _cuts(ruler: Column) -> Column:
    """Start and width of the columns under a ruler of equal signs, NULL without a ruler."""
    none = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,n:int>>").alias("cuts"))

    def step(done: Column, part: Column) -> Column:
        n = F.length(part)
        cut = F.array(F.struct(done["at"].alias("at"), n.alias("n")))
        return F.struct(
            (done["at"] + n + 1).alias("at"),
            F.when(n > 0, F.concat(done["cuts"], cut)).otherwise(done["cuts"]).alias("cuts"),
        )

    cuts = F.aggregate(F.split(F.rtrim(ruler), " "), none, step, lambda done: done["cuts"])
    return F.when(ruler.rlike(r"^=+(?: +=+)+ *$"), cuts)


def _cut(line: Column, cuts: Column) -> Column:
    """Cells of a line by column positions; the last column reaches to the end."""
    def cell(cut: Column, i: Column) -> Column:
        wide = F.when(i == F.size(cuts) - 1, F.length(line)).otherwise(cut["n"])
        return F.trim(F.substring(line, cut["at"], wide))

    return F.transform(cuts, cell)


def _line_fields(fmt: Column, section: Column, line: Column, headers: Column, cuts: Column) -> Column:
    """Fields of one line, NULL when it is not a data line of its format."""
    bare = F.trim(line)
    words = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    word = lambda i: F.try_element_at(words, F.lit(i + 1))
    n = F.size(words)
    colon = F.contains(line, F.lit(":"))
    key, value = before_colon(line), after_colon(line)
    number = r"^\d+$"
    last = F.try_element_at(words, F.lit(-1))
    task = lambda i: F.regexp_extract(
        bare, r"^((?:\S+\s+)*?\S*\.exe\S*)\s+(\S+)\s+(\S+)\s+(\S+)", i
    )
    wide = F.filter(F.transform(F.split(line, "  "), lambda c: F.trim(c)), lambda c: c != "")
    mark = F.startswith(bare, F.lit("==="))
    equals = F.contains(line, F.lit("="))
    left_of = F.trim(F.substring_index(line, "=", 1))
    right_of = F.trim(F.substring(line, F.instr(line, "=") + 1, F.length(line)))
    rules = {
        "key_value": (colon & (key != "") & (value != ""), _pair(key, value)),
        "net_user": (
            ~F.contains(line, F.lit("---")),
            F.transform(words, lambda u: F.struct(F.lit("user").alias("name"), u.alias("value"))),
        ),
        # By the ruler; a table without one has only words, told apart by the program's ending.
        "tasklist": (
            cuts.isNotNull() | (task(1) != ""),
            F.when(
                cuts.isNotNull(), F.filter(_cells(_cut(line, cuts), headers), lambda c: c["value"] != "")
            ).otherwise(
                _fields(name=F.regexp_replace(task(1), r"\s+", " "), pid=task(2), session=task(3), mem=task(4))
            ),
        ),
        "dashed_table": (~F.startswith(line, F.lit("===")), _cells(words, headers)),
        "wmic": (F.size(wide) >= 3, _cells(wide, headers)),
        "format_list": (colon & ~mark & (key != ""), _pair(key, value)),
        "netstat": (
            bare.rlike("^(?:TCP|UDP)") & (n >= 4),
            _fields(
                proto=word(0), local=word(1), foreign=word(2),
                state=F.when(word(3).rlike(number), "LISTENING").otherwise(word(3)),
                pid=F.when(last.rlike(number), last).otherwise("N/A"),
            ),
        ),
        "netstat_statistics": (
            F.lit(True),
            F.when(equals, _pair(left_of, right_of))
            .when(colon, _pair(key, value))
            .otherwise(_pair(bare, F.lit(None).cast("string"))),
        ),
        "arp": (
            (section != "") & (n >= 2)
            & ~F.contains(line, F.lit("Internet Address"))
            & ~F.contains(line, F.lit("Physical Address")),
            _fields(ip=word(0), mac=word(1), type=F.coalesce(word(2), F.lit(""))),
        ),
        "ipconfig": (colon & (key != "") & (value != ""), _pair(key, value)),
        "route": (
            (section != "") & (n >= 5) & word(0).rlike(r"^[0-9.]*[0-9][0-9.]*$"),
            _fields(network=word(0), netmask=word(1), gateway=word(2), interface=word(3), metric=word(4)),
        ),
        "sc_query": (colon, _pair(key, value)),
        "usb": (
            F.when(section == "device", colon & (key != "")).otherwise((section == "event") & (n >= 3)),
            F.when(section == "device", _pair(key, value)).otherwise(
                _fields(
                    time=F.concat_ws(" ", word(0), word(1)), event_id=word(2),
                    message=F.array_join(F.slice(words, F.lit(4), F.greatest(n - 3, F.lit(0))), " "),
                )
            ),
        ),
        "generic_key_value": (colon & (key != ""), _pair(key, value)),
    }
    out = None
    for name, (test, fields) in rules.items():
        found = F.when(test, fields.cast(FIELDS))
        out = F.when(fmt == name, found) if out is None else out.when(fmt == name, found)
    return out.otherwise(_fields(line=line).cast(FIELDS))


def parse_outputs(outputs: DataFrame) -> DataFrame:
    """Data lines of all outputs: the input columns but the text, format, section,
    section_no, line_no and fields."""
    keep = [c for c in outputs.columns if c != "output"]
    fmt, lines, text = F.col("format"), F.col("lines"), F.col("text")
    rows = outputs.filter(F.col("output").rlike(r"(?U)\S"))
    rows = once(rows, keep, {"text": clean_output(F.col("output"))})
    rows = once(
        rows, [*keep, "text"],
        {"format": output_format(F.col("cmd"), text), "lines": F.split(text, "\n")},
    )
    ruler = _first_line(lines, lambda l: F.contains(l, F.lit("---")))
    task_head = _first_line(lines, lambda l: l.rlike("Image Name|PID"))
    task_line = F.get(lines, task_head)
    cuts = F.when(fmt == "tasklist", _cuts(F.get(lines, task_head + 1)))
    start = (
        F.when(fmt == "tasklist", task_head + 2)
        .when(fmt == "dashed_table", F.when(ruler > 0, ruler + 1))
        .when(fmt == "net_user", ruler + 1)
        .when(fmt == "wmic", F.lit(2))
        .otherwise(F.lit(0))
    )
    wmic_header = F.split(F.trim(F.get(lines, F.lit(0))), r"\s{2,}")
    headers = (
        F.when(
            fmt == "dashed_table",
            F.split(F.trim(F.get(lines, F.greatest(ruler - 1, F.lit(0)))), r"\s+"),
        )
        .when(fmt == "tasklist", F.transform(_cut(task_line, cuts), lambda h: lookup(TASK_COLUMNS, h, h)))
        .when((fmt == "wmic") & (F.size(wmic_header) >= 3), wmic_header)
        .when(fmt == "wmic", F.array(*[F.lit(c) for c in USER_COLUMNS]))
    )
    rows = once(rows, [*keep, "text", "format", "lines"], {"start": start, "headers": headers, "cuts": cuts})
    # A table whose ruler or heading is missing has no data lines.
    rows = rows.filter(F.col("start").isNotNull())
    body = F.when(F.col("start") == 0, text).otherwise(
        F.array_join(F.slice(lines, F.col("start") + 1, F.size(lines)), "\n")
    )
    rows = rows.select(
        *keep, "format", "headers", "cuts",
        F.posexplode_outer(_sections(fmt, body)).alias("section_no", "section_text"),
    )
    first = F.substring_index("section_text", "\n", 1)
    headed = _is_header(fmt, first)
    # A routing table ends at its first blank or ruled line.
    part = F.when(
        (fmt == "route") & headed,
        F.get(F.split("section_text", r"(?m)^(?:\s*$|.*====.*$)", 2), F.lit(0)),
    ).otherwise(F.col("section_text"))
    rows = once(
        rows, [*keep, "format", "headers", "cuts", "section_no"],
        {
            "has_header": headed,
            "section": F.when(headed, _section_name(fmt, first)).otherwise(""),
            "section_lines": F.split(part, "\n"),
        },
    )
    rows = rows.select(
        *keep, "format", "headers", "cuts", "section_no", "section", "has_header",
        F.posexplode_outer("section_lines").alias("line_no", "line"),
    )
    rows = rows.filter(~(F.col("has_header") & (F.col("line_no") == 0)))
    rows = rows.filter(F.trim("line") != "")
    fields = _line_fields(fmt, F.col("section"), F.col("line"), F.col("headers"), F.col("cuts"))
    rows = once(rows, [*keep, "format", "section_no", "section", "line_no"], {"fields": fields})
    return rows.filter(F.col("fields").isNotNull())


def field(name: str) -> Column:
    """Value of a named field of a parsed line."""
    hit = F.filter("fields", lambda f: f["name"] == name)
    return F.get(hit, F.lit(0))["value"]


def wide(parsed: DataFrame, fmt: str, names: list[str]) -> DataFrame:
    """Lines of one fixed-column format with a column per field."""
    keep = [c for c in parsed.columns if c not in ("fields", "format")]
    return parsed.filter(F.col("format") == fmt).select(*keep, *[field(n).alias(n) for n in names])


def tall(parsed: DataFrame) -> DataFrame:
    """One row per field."""
    keep = [c for c in parsed.columns if c != "fields"]
    return parsed.select(*keep, F.posexplode("fields").alias("pos", "f")).select(
        *keep, "pos", F.col("f.name").alias("name"), F.col("f.value").alias("value")
    )


def external_connections(sockets: DataFrame) -> DataFrame:
    """Established connections to other machines (columns state and foreign)."""
    # the host without brackets, zone and port; IPv4 in IPv6 counts as IPv4
    host = F.regexp_replace(F.col("foreign"), r"^\[?(.*?)\]?(?::[0-9*]+)?$", "$1")
    host = F.regexp_replace(F.regexp_replace(F.lower(host), r"%.*$", ""), r"^::ffff:", "")
    local = host.rlike(r"^127(?:\.[0-9]{1,3}){3}$") | (host == "::1") | (host == "localhost")
    return sockets.filter(F.col("state").isin("ESTAB", "ESTABLISHED") & ~local)
