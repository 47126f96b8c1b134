"""Schemas of the evidence tables the operators read."""

EVIDENCE_FILES = (
    "host string, case_id string, label string, path string, size long, "
    "mtime timestamp, atime timestamp, content binary"
)
EVIDENCE_TEXT = "host string, label string, path string, size long, mtime timestamp, text string"
COMMAND_OUTPUTS = (
    "host string, os string, category string, cmd string, cmd_type string, output string, "
    "ts timestamp"
)
KNOWN_HASHES = "algorithm string, hash string, threat string, severity string"
HASH_INTEL = (
    "hash string, ts timestamp, malicious int, suspicious int, harmless int, undetected int, "
    "family string"
)
NOTES = "path string, note string, ts timestamp"
CHROMIUM_URLS = (
    "host string, browser string, url string, title string, visit_count long, "
    "typed_count long, last_visit_time long, hidden int"
)
FIREFOX_PLACES = (
    "host string, url string, title string, visit_count long, typed long, "
    "last_visit_date long, hidden int"
)
SAFARI_ITEMS = "id long, url string, domain_expansion string, visit_count long"
SAFARI_VISITS = "history_item long, visit_time double, title string"
WINDOWS_EVENTS = (
    "host string, log string, ts timestamp, event_id int, source string, category int, "
    "computer string, sid string, strings array<string>"
)
REGISTRY_VALUES = (
    "host string, hive string, key_path string, value_name string, value_type int, "
    "value_text string, value_data binary"
)
MFT_RECORDS = (
    "volume string, entry_number long, sequence_number int, is_directory boolean, "
    "is_deleted boolean, si_created timestamp, si_modified timestamp, si_accessed timestamp, "
    "si_mft_modified timestamp, fn_created timestamp, fn_modified timestamp, filename string, "
    "parent_reference long, parent_sequence int, logical_size long, physical_size long, "
    "is_resident boolean, data_runs array<struct<start:long,n:long>>, ads_streams array<string>"
)
ALLOCATED_EXTENTS = "volume string, start long, end_excl long"
IMAGE_CHUNKS = "image string, chunk_no long, offset long, bytes binary"
