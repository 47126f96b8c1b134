"""Seed lines that make the patterns fire. Keys and numbers are dummies, put together
here so that no secret scanner takes them for real ones."""

LINES = [
    "mail a.b@ex.com x@mailinator.com 10.0.0.1 8.8.8.8 192.168.1.9 fe80:0000:0000:0000:0202:b3ff:fe1e:8329",
    "http://evil.tk/p?q=1 https://bit.ly/abc abcdefghijklmn.ru expyuzz4wqqyqhjn.onion call +1 555-123-4567",
    "port 4444 3389 nc -e /bin/bash -i \\\\srv01\\share$ ftp://u:p@h",
    "dropbox.com pastebin.com mega.nz mediafire.com " + "a" * 34 + ".evil.com",
    "C:\\Windows\\Temp\\a.exe HKEY_LOCAL_MACHINE\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Run /etc/passwd",
    "4111111111111111 5500000000000004 371449635398431 078-05-1120 00:1A:2B:3C:4D:5E 123e4567-e89b-12d3-a456-426614174000",
    "C:\\Users\\bob\\AppData\\Roaming\\Microsoft\\Windows\\Start Menu\\Programs\\Startup\\x.lnk",
    "C:\\ProgramData\\e.exe %TEMP%\\q.exe \\Microsoft\\Windows\\CurrentVersion\\Schedule\\TaskCache "
    "Chrome\\User Data\\Default\\Extensions svchost32",
    "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa 0x" + "ab" * 20 + " 49A" + "A" * 92,
    "0" * 31 + "a " + "1" * 39 + "b " + "2" * 63 + "c " + "3" * 127 + "d",
    "eyJhbGci.eyJzdWIi.abc-_1 " + "QUJD" * 20 + " \\x41\\u0041",
    "invoice.pdf.exe",
    "run.vbs\r",
    "run.ps1",
    "end.js",
    'password = "hunter2" api_key: ' + "k" * 24 + " Server=db; Uid=x",
    "\n".join("-----BEGIN " + k + " PRIVATE KEY-----" for k in ("RSA", "DSA", "OPENSSH")),
    "AKIA" + "ABCDEFGHIJKLMNOP" + " ghp_" + "a" * 36 + " xoxb-" + "123456789012" + " AIza" + "b" * 35,
    "sk_live_" + "c" * 24 + " SK" + "d" * 32 + " key-" + "e" * 32 + " " + "aB3/" * 10,
    "mimikatz lsass meterpreter rat remote-access WannaCry file.locked keylog GetAsyncKeyState rootkit "
    "screenshot CreateRemoteThread IsDebuggerPresent UPX xmrig",
    "your files have been encrypted decrypt/i",
    "driver-inject kernel-module lazagne sandbox-detect VMProtect cryptonight ransomware",
    "' or 1=1 union  select drop table;-- <script>alert</script> onerror= <iframe | whoami ; curl ../etc "
    "*)(uid=* <!ENTITY {{7*7}} ${x} <% y %>",
    "Invoke-WebRequest IEX DownloadString -ExecutionPolicy Bypass -w hidden -enc " + "QUJD" * 20
    + " schtasks at 9 sc.exe create New-Service wmic process call create __EventFilter "
    "x[System.Reflection.Assembly]::Load Load(byte[]",
    "Set-MpPreference -DisableRealtimeMonitoring AmsiScanBuffer AppInit_DLLs",
    "eval( setTimeout( String.fromCharCode chr( strrev split(\"[\"]\").reverse() \\x42 +'a+'+'b+'+'c+'",
    "2345 6789 0123 ABCDE1234F ABC1234567 MH12 12345678901 27ABCDE1234F1Z5 123456789012 HDFC0ABC123 "
    "bob@okaxis +91 9876543210 A12 34567 89012 3",
    "na\u00efve\u00e9@ex.com \u0663\u0664\u0665-12-1234 \u017fcreenshot Kelvin \u212aeylog \u00e9val( 10.0.0.1\u00e9 m\u0130m\u0131katz",
    "line1\r\nx.hta\r\nx.bat\u2028y.wsf\u0085z.jse",
    "plain words without anything",
    "",
]
