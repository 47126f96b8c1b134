"""Cheap tests that must hold before an expression can match.

Running every expression over every text is the cost of a scan. Most texts lack
the one word or character shape an expression needs, so each expression gets a
*gate*: literals of which one must occur, or a shape that must occur, in the
folded text (``functions.text.fold``). A gate never decides a match; it only
skips an expression that cannot match. ``tests/test_scan.py`` checks that gated
and ungated scans agree.
"""

# Shapes are tested once per text and shared by all expressions that need them.
SHAPES = {
    "long_run": r"[a-z0-9+/=_-]{26}",
    "dotted_quad": r"(?U)\d\.\d{1,3}\.\d{1,3}\.\d",
    "word_dot_word": r"[a-z0-9]\.[a-z]",
    "suspect_end": (
        r"[a-z0-9]\.(?:tk|ml|ga|cf|gq|pw|cc|ws|top|xyz|club|online|site|website|space|live)"
    ),
    "common_end": r"[a-z]\.(?:com|net|org|ru|cn)",
    # i, k and s may stand for folded letters that are not ASCII, so they end no word
    "word_rat": r"rat(?![0-9a-hjl-rt-z_])(?<![0-9a-hjl-rt-z_]rat)",
    "at_digit": r"(?U)at\s+\d",
    "or_one": r"(?U)or\s+1",
    "hex_colon": r"[0-9a-f]:[0-9a-f]{1,4}:",
    "hex_pairs": r"[0-9a-f]{2}[:-][0-9a-f]{2}[:-]",
    "hex_groups": r"[0-9a-f]{4}-[0-9a-f]{4}-",
    "digits_7": r"(?U)\d{3}[-.\s]?\d{4}",
    "digits_8": r"(?U)\d{4}\s?\d{4}",
    "digits_13": r"[0-9]{13}",
    "digits_dashed": r"(?U)\d-\d\d-\d",
    "letters_digits": r"(?U)[a-z]{5}\d{4}",
    "bank_code": r"[a-z]{4}0[a-z0-9]{6}",
    "program_suffix": r"\.(?:exe|scr|com|bat|cmd|vb|js|ws|hta|ps1|pif|msi|dll)",
}

# Most texts hold no digit at all: one cheap test spares them every shape and number
# that needs one.
DIGIT = r"\p{Nd}"
DIGIT_SHAPES = {
    "dotted_quad", "at_digit", "or_one", "digits_7", "digits_8", "digits_13", "digits_dashed", "letters_digits",
    "bank_code",
}
DIGIT_NEEDLES = {"c2_port", "remote_desktop"}

SHAPE_OF = {
    "ipv4": "dotted_quad",
    "ipv4_address": "dotted_quad",
    "private_ip": "dotted_quad",
    "ipv6": "hex_colon",
    "ipv6_address": "hex_colon",
    "domain": "word_dot_word",
    "suspicious_tld": "suspect_end",
    "suspicious_domain": "suspect_end",
    "dga_domain": "common_end",
    "phone": "digits_7",
    "creditcard": "digits_13",
    "credit_card": "digits_13",
    "bitcoin": "long_run",
    "bitcoin_address": "long_run",
    "ethereum": "long_run",
    "ethereum_address": "long_run",
    "monero": "long_run",
    "monero_address": "long_run",
    "ssn": "digits_dashed",
    "social_security": "digits_dashed",
    "md5_hash": "long_run",
    "sha1_hash": "long_run",
    "sha256_hash": "long_run",
    "sha512_hash": "long_run",
    "mac_address": "hex_pairs",
    "uuid": "hex_groups",
    "base64": "long_run",
    "base64_encoded": "long_run",
    "suspicious_extension": "program_suffix",
    "double_extension": "program_suffix",
    "executable_disguise": "program_suffix",
    "script_extension": "program_suffix",
    "suspicious_script": "program_suffix",
    "aws_secret": "long_run",
    "aws_secret_key": "long_run",
    "google_api": "long_run",
    "twilio_key": "long_run",
    "mailgun_key": "long_run",
    "powershell_encoded": "long_run",
    "dns_tunneling": "long_run",
    "aadhar_card": "digits_8",
    "driving_license": "digits_8",
    "passport": "digits_8",
    "bank_account": "digits_8",
    "phone_number": "digits_8",
    "voter_id": "digits_7",
    "pan_card": "letters_digits",
    "gstin": "letters_digits",
    "ifsc_code": "bank_code",
}

# A shape that opens a gate beside the needles.
ALSO_SHAPE = {
    "backdoor_pattern": "word_rat",
    "backdoor_keyword": "word_rat",
    "scheduled_task": "at_digit",
    "sql_injection": "or_one",
}

NEEDLES = {
    "email": ["@"],
    "temp_email": ["@"],
    "upi_id": ["@"],
    "url": ["://"],
    "url_shortener": ["://"],
    "file_path": ["/", ":\\"],
    "registry_key": ["hkey_"],
    "autorun_key": ["hkey_"],
    "registry_autorun": ["hkey_"],
    "jwt_token": [".ey"],
    "hex_string": ["0x", "\\x"],
    "hex_encoded": ["0x", "\\x"],
    "hex_obfuscation": ["\\x"],
    "unicode_escape": ["\\u"],
    "tor_onion": [".onion"],
    "password_in_code": ["passw", "pwd"],
    "hardcoded_password": ["passw", "pwd"],
    "api_key": ["apikey", "api_", "api-", "accesstoken", "access_", "access-"],
    "api_key_generic": [
        "apikey", "apisecret", "api_", "api-", "accesstoken", "access_", "access-",
        "authtoken", "auth_", "auth-",
    ],
    "private_key": ["-----begin "],
    "ssh_key": ["-----begin "],
    "connection_string": [
        "server", "data source", "initial catalog", "user id", "password", "uid", "pwd",
    ],
    "aws_key": ["akia"],
    "aws_access_key": ["akia", "asia"],
    "github_token": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "slack_token": ["xox"],
    "stripe_key": ["sk_", "pk_"],
    "backdoor_pattern": [
        "backdoor", "trojan", "rootkit", "remote", "metasploit", "meterpreter",
        "cobaltstrike", "empire",
    ],
    "backdoor_keyword": [
        "backdoor", "trojan", "rootkit", "remote", "metasploit", "meterpreter",
        "cobaltstrike", "empire",
    ],
    "ransomware_pattern": [
        "ransomware", "wannacry", "cryptolocker", "locky", "cerber", "petya", "ryuk", "maze",
        "sodinokibi", "revil", "darkside", "conti",
    ],
    "ransomware_keyword": [
        "ransomware", "wannacry", "cryptolocker", "locky", "cerber", "petya", "ryuk", "maze",
        "sodinokibi", "revil", "darkside", "conti",
    ],
    "ransomware_extension": [
        ".encrypted", ".locked", ".crypto", ".cerber", ".locky", ".zepto", ".osiris", ".thor",
        ".aesir", ".zzzzz",
    ],
    "ransomware_note": [
        "encrypted", "decrypt", "ransom", "bitcoin", "payment", "restore", "recovery",
    ],
    "keylogger_pattern": [
        "keylog", "keystroke", "keypress", "key_", "key-", "getasynckeystate",
        "setwindowshookex",
    ],
    "keylogger_keyword": [
        "keylog", "keystroke", "keypress", "key_", "key-", "keyboard", "getasynckeystate",
        "setwindowshookex",
    ],
    "rootkit_pattern": ["rootkit", "kernel", "driver"],
    "credential_dumper": [
        "mimikatz", "lsass", "sam.hive", "ntds.dit", "secretsdump", "lazagne", "dumpcreds",
    ],
    "credential_theft": [
        "mimikatz", "lsass", "sam.hive", "ntds.dit", "secretsdump", "lazagne", "dumpcreds",
    ],
    "screen_capture": ["screen", "bitblt", "gdipcreatebitmap"],
    "process_injection": [
        "createremotethread", "writeprocessmemory", "virtualallocex", "setthreadcontext",
        "queueuserapc", "hollow",
    ],
    "anti_analysis": [
        "debuggerpresent", "ntqueryinformationprocess", "antivm", "anti-vm", "anti_vm", "detect",
    ],
    "packer": [
        "upx", "themida", "vmprotect", "armadillo", "enigma", "aspack", "pecompact", "molebox",
    ],
    "packer_signature": [
        "upx", "themida", "vmprotect", "armadillo", "enigma", "aspack", "pecompact", "molebox",
    ],
    "crypto_miner": ["xmrig", "miner", "cryptonight"],
    "sql_injection": ["union", "drop", "exec", ";--"],
    "xss_pattern": ["<script", "javascript:", "onerror", "onclick", "<iframe"],
    "command_injection": [";", "|", "&", "`"],
    "path_traversal": ["../", "..\\", "..%2f", "%252e"],
    "ldap_injection": ["*)("],
    "xml_injection": ["<!"],
    "template_injection": ["{{", "${", "<%"],
    "powershell_download": [
        "invoke-webrequest", "iwr", "iex", "download", "wget", "curl", "webclient",
    ],
    "powershell_execution": ["invoke-", "iex", "icm", "start-process"],
    "powershell_bypass": ["-e"],
    "powershell_hidden": ["hidden"],
    "powershell_reflective": ["load"],
    "reflective_load": ["load"],
    "registry_persistence": ["currentversion", "startup", "appinit_dlls"],
    "scheduled_task": ["schtasks", "scheduledtask"],
    "service_creation": ["sc.exe", "new-service", "createservice"],
    "wmi_persistence": ["wmic", "__event", "activescript"],
    "disable_av": ["set-mppreference", "disable-windows", "stop-service"],
    "bypass_amsi": ["amsi"],
    "javascript_eval": ["eval", "function", "settimeout", "setinterval"],
    "string_concat": ["+"],
    "char_code": ["fromcharcode", "chr(", "char("],
    "reverse_string": ["strrev", "split("],
    "startup_folder": ["startup"],
    "dll_hijacking": ["dlls", "ifeo", "image file"],
    "task_scheduler": ["taskcache"],
    "browser_extension": ["extensions", "profiles"],
    "suspicious_filename": [
        "svchost32", "csrss32", "lsass32", "winlogon32", "explorer32", "system32.exe",
        "notepad32",
    ],
    "suspicious_location": ["c:\\windows\\t", "programdata", "%appdata%", "%temp%"],
    "c2_port": ["4444", "8080", "31337", "12345", "54321", "1337", "6667", "6666", "9999"],
    "remote_desktop": ["3389", "5900", "5901"],
    "reverse_shell": ["-e", "-l", "-i"],
    "smb_share": ["\\\\"],
    "ftp_credentials": ["ftp://"],
    "cloud_storage": ["dropbox", "drive.google", "onedrive", "mega.nz", "wetransfer"],
    "pastebin": ["paste", "bin.com"],
    "file_sharing": ["filebin", "sendspace", "zippyshare", "mediafire"],
}
