"""Lookup tables and word lists.

Every table in this module is a fixed value: labels, codes, weights and words
decide what a result row says, so they are stated here once, as plain data.
"""

# Indicator score per distinct match, by severity.
SEVERITY_WEIGHT = {"CRITICAL": 50, "HIGH": 25, "MEDIUM": 10, "LOW": 2}

# Suspicious-text category -> (score per distinct match, severity).
SUSPICIOUS_CATEGORY = {
    "credentials": (15, "Critical"),
    "malware_indicators": (20, "Critical"),
    "injection_attacks": (12, "High"),
    "suspicious_commands": (10, "High"),
    "obfuscation": (8, "Medium"),
    "persistence_mechanisms": (15, "High"),
    "file_indicators": (12, "High"),
    "network_indicators": (10, "Medium"),
    "data_exfiltration": (18, "Critical"),
}

# Personal-data type -> investigative points.
INVESTIGATIVE_POINTS = {
    "pan_card": 5,
    "credit_card": 4,
    "bank_account": 4,
    "aadhar_card": 5,
    "passport": 4,
    "driving_license": 3,
    "voter_id": 3,
    "gstin": 3,
    "social_security": 4,
    "phone_number": 2,
    "email": 1,
}

# Words that make a text look like a form or an official paper.
FORM_WORDS = ["name:", "address:", "phone:", "date of birth", "account number", "card number"]
OFFICIAL_WORDS = [
    "statement", "certificate", "license", "registration", "invoice", "receipt", "contract",
]

# File names with low value for an investigation.
TEST_NAME_WORDS = ["test", "sample", "example", "demo", "temp", "tmp"]
SCREENSHOT_NAME_WORDS = ["at ", "am.", "pm."]

# Extensions read by the personal-data scan, by category.
SCAN_EXTENSIONS = {
    "text": [".txt", ".log", ".csv", ".tsv", ".json", ".xml", ".md"],
    "pdf": [".pdf"],
    "document": [".docx", ".doc"],
    "image": [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff"],
    "video": [".mp4", ".avi", ".mov", ".mkv", ".wmv", ".flv"],
    "spreadsheet": [".xlsx", ".xls"],
    "code": [".py", ".js", ".html", ".css", ".java", ".cpp", ".c", ".php", ".rb"],
    "data": [".json", ".xml", ".csv", ".tsv"],
}

# Common MIME types by extension (IANA names).
MIME_TYPES = {
    ".txt": "text/plain",
    ".log": "text/plain",
    ".csv": "text/csv",
    ".tsv": "text/tab-separated-values",
    ".json": "application/json",
    ".xml": "text/xml",
    ".md": "text/markdown",
    ".pdf": "application/pdf",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xls": "application/vnd.ms-excel",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".gif": "image/gif",
    ".bmp": "image/bmp",
    ".tiff": "image/tiff",
    ".mp4": "video/mp4",
    ".avi": "video/x-msvideo",
    ".mov": "video/quicktime",
    ".html": "text/html",
    ".css": "text/css",
    ".js": "text/javascript",
    ".py": "text/x-python",
    ".c": "text/plain",
}

# Directories the personal-data scan does not enter.
EXCLUDED_DIRS = [".git", "__pycache__", "node_modules", ".vscode", ".idea"]
SYSTEM_DIRS = ["System32", "Windows", "AppData"]

# Extensions skipped by the text scan when no allow-list is given.
BINARY_EXTENSIONS = [".exe", ".dll", ".bin", ".jpg", ".png", ".mp4", ".zip"]

# Executable or script extensions, and places they should not be in.
RISKY_EXTENSIONS = [
    ".exe", ".dll", ".sys", ".scr", ".bat", ".cmd", ".ps1", ".vbs",
    ".js", ".jar", ".msi", ".com", ".pif", ".cpl", ".hta",
    ".sh", ".bin", ".run", ".so",
    ".app", ".dmg", ".pkg",
    ".py", ".rb", ".pl", ".php",
]
RISKY_LOCATIONS = [
    "temp", "tmp", "download", "downloads", "appdata", "cache",
    ".cache", "trash", ".trash", "recycl", "temporary",
]

# Known-bad hashes (hash, threat).
KNOWN_BAD = [
    ("24d004a104d4d54034dbcffc2a4b19a11f39008a575aa614ea04703480b1022c", "WannaCry Ransomware"),
    ("ed01ebfbc9eb5bbea545af4d01bf5f1071661840480439c6e5babe8e080e41aa", "WannaCry Ransomware"),
    ("4a767b4a6e8e5d6c4d9c0b2e7f8a9c1d", "Emotet Trojan"),
    ("b24c5ffffa3b9a33a0a42e29a2f53e5c", "Mimikatz (Credential Theft Tool)"),
]

# Extension -> encryption label.
ENCRYPTED_EXTENSIONS = {
    ".7z": "Encrypted 7-Zip Archive",
    ".zip": "Potentially Encrypted ZIP",
    ".rar": "Potentially Encrypted RAR",
    ".aes": "AES Encrypted File",
    ".pgp": "PGP Encrypted File",
    ".gpg": "GPG Encrypted File",
    ".tc": "TrueCrypt Container",
    ".hc": "VeraCrypt Container",
    ".dmg": "macOS Disk Image (may be encrypted)",
    ".sparsebundle": "macOS Sparse Bundle (may be encrypted)",
    ".sparseimage": "macOS Sparse Image (may be encrypted)",
    ".docx": "Password-Protected Word Document",
    ".xlsx": "Password-Protected Excel Spreadsheet",
    ".pptx": "Password-Protected PowerPoint",
    ".pdf": "Password-Protected PDF",
    ".kdbx": "KeePass Database",
    ".axx": "AxCrypt Encrypted File",
    ".crypted": "Generic Encrypted File",
    ".encrypted": "Generic Encrypted File",
    ".enc": "Encrypted File",
    ".vault": "Vault Encrypted File",
    ".wallet": "Cryptocurrency Wallet",
    ".dat": "Potential Bitcoin Wallet",
}
CONTAINER_EXTENSIONS = [".tc", ".hc", ".vault"]
ENCRYPTED_FORMATS = [".7z", ".aes", ".pgp", ".gpg", ".kdbx", ".axx"]

# System path prefixes the encrypted-file scan skips, by platform.
SYSTEM_PREFIXES = {
    "windows": [
        "C:\\Windows", "C:\\Program Files", "C:\\Program Files (x86)",
        "C:\\ProgramData\\Microsoft", "C:\\$Recycle.Bin", "C:\\System Volume Information",
    ],
    "macos": [
        "/System", "/Library/Apple", "/private/var", "/usr", "/bin", "/sbin", "/cores", "/dev",
    ],
    "linux": ["/sys", "/proc", "/dev", "/boot", "/usr/lib", "/usr/share"],
}

# Event id -> name.
EVENT_NAMES = {
    4624: "Successful Logon",
    4625: "Failed Logon",
    4634: "Logoff",
    4648: "Explicit Credentials Logon",
    4672: "Special Privileges Assigned",
    4720: "User Account Created",
    4722: "User Account Enabled",
    4732: "User Added to Security Group",
    4756: "User Added to Universal Security Group",
    4776: "Domain Controller Authentication",
    7045: "Service Installed",
    7040: "Service Start Type Changed",
    6005: "Event Log Service Started",
    6006: "Event Log Service Stopped",
    1074: "System Shutdown/Restart",
    20001: "USB Device Plugged In",
    20003: "USB Device Removed",
    6416: "External Device Recognized",
    4103: "PowerShell Module Logging",
    4104: "PowerShell Script Block Logging",
    400: "PowerShell Engine Started",
    403: "PowerShell Engine Stopped",
    1149: "Remote Desktop Connection",
    21: "Remote Desktop Services: Session Logon",
    22: "Remote Desktop Services: Shell Start",
    24: "Remote Desktop Services: Session Disconnect",
    25: "Remote Desktop Services: Session Reconnection",
    1000: "Application Error",
    1001: "Application Hang",
}

# Event ids and paths the detectors look at.
LOGON_OK, LOGON_FAILED, SERVICE_INSTALLED = 4624, 4625, 7045
REMOTE_ACCESS_IDS = [1149, 21, 22, 24, 25]
PRIVILEGE_IDS = [4672, 4720, 4732]
USB_IDS = [20001, 20003, 6416]
SERVICE_LOCATIONS = [
    "temp", "appdata", "programdata", "users\\public", "windows\\temp", "perflogs",
]

# Browser visit types.
CHROMIUM_TRANSITIONS = {
    0: "Link Click",
    1: "Typed URL",
    2: "Auto Bookmark",
    3: "Auto Subframe",
    4: "Manual Subframe",
    5: "Generated",
    6: "Auto Toplevel",
    7: "Form Submit",
    8: "Reload",
    9: "Keyword",
    10: "Keyword Generated",
}
FIREFOX_VISITS = {
    1: "Link",
    2: "Typed",
    3: "Bookmark",
    4: "Embed",
    5: "Redirect Permanent",
    6: "Redirect Temporary",
    7: "Download",
    8: "Framed Link",
    9: "Reload",
}

# Registry key paths and service start types.
RUN_KEYS = {
    ("HKLM", "SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Run"): "HKLM Run",
    ("HKLM", "SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\RunOnce"): "HKLM RunOnce",
    ("HKCU", "Software\\Microsoft\\Windows\\CurrentVersion\\Run"): "HKCU Run",
    ("HKCU", "Software\\Microsoft\\Windows\\CurrentVersion\\RunOnce"): "HKCU RunOnce",
}
USERASSIST_KEY = "Software\\Microsoft\\Windows\\CurrentVersion\\Explorer\\UserAssist"
RECENT_DOCS_KEY = "Software\\Microsoft\\Windows\\CurrentVersion\\Explorer\\RecentDocs"
USBSTOR_KEY = "SYSTEM\\CurrentControlSet\\Enum\\USBSTOR"
TYPED_URLS_KEY = "Software\\Microsoft\\Internet Explorer\\TypedURLs"
UNINSTALL_KEYS = [
    ("HKLM", "SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Uninstall"),
    ("HKLM", "SOFTWARE\\WOW6432Node\\Microsoft\\Windows\\CurrentVersion\\Uninstall"),
    ("HKCU", "Software\\Microsoft\\Windows\\CurrentVersion\\Uninstall"),
]
NETWORK_PROFILES_KEY = "SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\NetworkList\\Profiles"
MRU_KEYS = [
    "Software\\Microsoft\\Windows\\CurrentVersion\\Explorer\\ComDlg32\\OpenSavePidlMRU",
    "Software\\Microsoft\\Windows\\CurrentVersion\\Explorer\\ComDlg32\\LastVisitedPidlMRU",
]
SERVICES_KEY = "SYSTEM\\CurrentControlSet\\Services"
SERVICE_START = {0: "Boot", 1: "System", 2: "Automatic", 3: "Manual", 4: "Disabled"}

# Path words that make a large file suspicious.
HIDING_PLACES = ["$recycle", "temp", "tmp", "cache"]

# Words that make a carved string sensitive.
SENSITIVE_WORDS = [
    "password", "passwd", "pwd", "pass", "secret", "key",
    "credit", "card", "ssn", "social", "security",
    "account", "login", "username", "email",
    "bank", "routing", "pin", "cvv",
]
SENSITIVE_TYPES = ["password", "credit_card", "ssn"]
SOCIAL_SITES = ["facebook", "twitter", "instagram"]
SHOPPING_SITES = ["amazon", "ebay", "shop"]

# Text that tells a PowerShell command from a cmd one.
POWERSHELL_WORDS = [
    "Get-", "Set-", "New-", "Remove-", "Add-", "Clear-", "Export-", "Import-",
    "Select-Object", "Where-Object", "ForEach-Object", "Sort-Object",
    "Write-Output", "Write-Host", "Out-File",
    "$_", "|", "-eq", "-ne", "-like", "-match",
    "Format-List", "Format-Table",
    "Get-WinEvent", "Get-EventLog", "Get-Process", "Get-Service",
    "Get-ChildItem", "Get-ItemProperty", "Get-Content",
    "-ErrorAction", "-Recurse", "-Filter",
]

# Categories of captured output that are requests for analysis, not text.
ANALYSIS_CATEGORIES = ["regex_analysis", "hash_analysis"]

# Descriptions of captured commands.
COMMAND_DESCRIPTIONS = {
    "net user": "Display all user accounts on the system",
    "wmic useraccount list": "List detailed user account information",
    "Get-LocalUser|Format-List": "Show local user accounts with full details",
    'ipconfig /all':
        'Display complete network configuration (IP addresses, DNS, MAC addresses)',
    "netstat -nao": "Show all active network connections with process IDs",
    "netstat -e": "Display network interface statistics (packets sent/received, errors)",
    "netstat -s": "Show detailed protocol statistics (TCP, UDP, ICMP)",
    "arp -a": "Display ARP cache (IP to MAC address mappings)",
    "route print": "Show network routing table",
    "Get-NetAdapter|Format-List": "List all network adapters with detailed properties",
    'Get-NetIPAddress|Format-Table -AutoSize':
        'Display IP address configuration for all interfaces',
    "Get-NetRoute|Format-Table -AutoSize": "Show routing table entries",
    "netstat -naob": "Show active connections with process names (requires admin)",
    "$usb=Get-ChildItem HKLM:\\SYSTEM\\CurrentControlSet\\Enum\\USBSTOR -Recurse -ErrorAction SilentlyContinue|Get-ItemProperty -ErrorAction SilentlyContinue|Select-Object FriendlyName,PSChildName,DeviceDesc,Mfg,Service;$events=Get-WinEvent -LogName System|Where-Object {$_.Id -eq 2100 -or $_.Id -eq 2101 -or $_.Message -like '*USB*'}|Select-Object TimeCreated,Id,Message;Write-Output '=== USB DEVICE INFO ===';$usb;Write-Output '=== USB INSERT / REMOVE EVENTS ===';$events":
        'Retrieve USB device history and connection events',
    'Get-ChildItem "$env:APPDATA\\Microsoft\\Windows\\Recent" -Filter *.lnk|ForEach-Object {$s=(New-Object -ComObject WScript.Shell).CreateShortcut($_.FullName);$t=$s.TargetPath;if([string]::IsNullOrWhiteSpace($t)){$status=\'No Target / Invalid Link\'}elseif(Test-Path $t){$status=\'Exists\'}else{$status=\'Deleted/Moved\'};Write-Output (\'LinkFile=\'+$_.Name+\' | LastAccess=\'+$_.LastAccessTime+\' | Target=\'+$t+\' | Status=\'+$status)}':
        'Show recently opened files with access time and target status',
    'Get-ChildItem C:\\Windows\\Prefetch\\ -Filter *.pf|ForEach-Object {$name=$_.Name;$time=$_.LastWriteTime;$source=$name -replace \'_.*\',\'\';Write-Output ("PrefetchFile=$name | LastModified=$time | SourceEXE=$source.exe")}':
        'Analyze prefetch files to show executed programs with timestamps',
    'Get-ChildItem C:\\Windows\\Prefetch\\|Select-Object Name,LastWriteTime,Length|Format-Table -AutoSize':
        'List prefetch files with last modified time and size',
    '$profiles = (netsh wlan show profiles) | Select-String \'\\:(.+)$\' | ForEach-Object { $_.Matches.Groups[1].Value.Trim() }; foreach ($profile in $profiles) { Write-Host "Profile: $profile" -ForegroundColor Cyan; netsh wlan show profile name=$profile key=clear | Select-String \'Key Content\' }':
        'Extract saved WiFi network names and passwords from WLAN profiles',
    'wevtutil qe system /q:"*[System[(EventID=6005)]]" /f:text /c:20':
        'Display system boot/startup events (Event ID 6005)',
    'wevtutil qe system /q:"*[System[(EventID=1074)]]" /f:text /c:20':
        'Show logon/logoff and shutdown events (Event ID 1074)',
    "tasklist": "List all running processes",
    "tasklist /svc": "Show processes with associated services",
    'Get-Process|Select-Object Name,Id,CPU,WorkingSet|Sort-Object CPU -Descending|Select-Object -First 20|Format-Table -AutoSize':
        'Display top 20 processes by CPU usage',
    "sc query": "List all Windows services and their status",
    "Get-Service|Format-Table -AutoSize": "Display all services with status",
    "Get-Service|Where-Object {$_.Status -eq 'Running'}|Format-Table Name,DisplayName,Status -AutoSize":
        'Show only running services',
    "Get-Service|Where-Object {$_.Status -eq 'Running'}|Select-Object Name,DisplayName,Status|Format-Table -AutoSize":
        'List running services with details',
    "systeminfo": "Display comprehensive system information (OS, hardware, updates)",
    'Get-ComputerInfo|Select-Object CsName,OsName,OsVersion,OsArchitecture,BiosSeralNumber|Format-List':
        'Show computer and OS details',
    'Get-HotFix|Select-Object -First 20|Format-Table -AutoSize':
        'List recently installed Windows updates',
    "uname -a": "Display kernel version, architecture, and hostname",
    "lscpu": "Show detailed CPU architecture information",
    "free -h": "Display memory usage in human-readable format",
    "df -h": "Show disk space usage",
    "uptime": "Display system uptime and load average",
    "cat /etc/passwd": "List all user accounts on the system",
    "cat /etc/shadow 2>/dev/null || echo 'Access denied (requires root)'":
        'View password hashes (requires root)',
    "cat /etc/group": "Display all groups",
    "who": "Show currently logged-in users",
    "w": "Display detailed user session information",
    "last -n 20": "Show last 20 login records",
    "lastlog": "Display last login time for all users",
    "ps aux": "List all running processes with CPU and memory usage",
    "ps -ef": "Display full process list with parent-child relationships",
    "top -b -n 1 | head -n 30": "Snapshot of top processes by resource usage",
    "pstree -p": "Show process tree with PIDs",
    "lsof | head -n 100": "List open files and network connections",
    "ip addr show || ifconfig -a": "Display network interface configuration",
    "ss -tunapl || netstat -tunapl": "Show all TCP/UDP connections with process info",
    "ss -antup || netstat -antup": "Display active network connections",
    "ip route || route -n": "Show routing table",
    "arp -a || ip neigh": "Display ARP cache",
    "lsof -i -n -P": "List network connections with processes",
    'systemctl list-units --type=service || service --status-all':
        'List all services (systemd or SysV)',
    "systemctl list-unit-files --type=service": "Show service unit files and their states",
    "chkconfig --list 2>/dev/null || echo 'chkconfig not available'":
        'List services (RHEL/CentOS legacy)',
    "lsusb": "List all USB devices",
    "lsusb -v 2>/dev/null | head -n 100": "Detailed USB device information",
    "dmesg | grep -i usb | tail -n 50": "Show USB-related kernel messages",
    "journalctl -n 100 || echo 'journalctl not available'":
        'Display last 100 system log entries',
    "journalctl --since '1 hour ago' || echo 'journalctl not available'":
        'Show logs from the last hour',
    "tail -n 100 /var/log/syslog 2>/dev/null || echo '/var/log/syslog not accessible'":
        'Recent system log entries',
    "tail -n 100 /var/log/auth.log 2>/dev/null || tail -n 100 /var/log/secure 2>/dev/null || echo 'auth logs not accessible'":
        'Authentication and authorization logs',
    "nmcli device wifi list 2>/dev/null || echo 'nmcli not available'":
        'List available WiFi networks',
    'system_profiler SPSoftwareDataType':
        'Display macOS version and system software information',
    "system_profiler SPHardwareDataType": "Show hardware specifications",
    "sw_vers": "Display macOS version details",
    "sysctl -a | head -n 50": "Show system parameters and configuration",
    "vm_stat": "Display virtual memory statistics",
    "dscl . list /Users": "List all user accounts",
    "dscacheutil -q user": "Query user account information from directory services",
    "launchctl list": "List all running launch agents and daemons",
    "sudo launchctl list 2>/dev/null || echo 'Run with sudo for system services'":
        'List system-wide services',
    "system_profiler SPUSBDataType": "Display all USB devices and controllers",
    "ioreg -p IOUSB -w0 | head -n 100": "Show USB device registry information",
    "system_profiler SPNetworkDataType": "Display network hardware and configuration",
    "networksetup -listallhardwareports": "List all network hardware ports",
    "log show --last 1h --style syslog 2>/dev/null | head -n 100 || echo 'Requires admin access'":
        'Show system logs from the last hour',
    "mdfind 'kMDItemFSContentChangeDate >= $time.now(-86400)' 2>/dev/null | head -n 50 || echo 'Spotlight search unavailable'":
        'Find files modified in the last 24 hours using Spotlight',
    'ANALYZE_ALL_OUTPUTS_FOR_IOCS':
        'Scan all collected data for Indicators of Compromise (suspicious patterns)',
    "HASH_SYSTEM_FILES": "Calculate cryptographic hashes of system files",
    "HASH_TEMP_EXECUTABLES": "Hash files in temporary directories",
    "HASH_STARTUP_PROGRAMS": "Hash programs in startup folders",
}

# Crash dump setting -> label.
CRASH_DUMP_TYPES = {0: "None", 1: "Complete", 2: "Kernel", 3: "Small (Minidump)", 7: "Automatic"}
