"""Rule catalogue: the built-in detection rules and a loader for custom ones.

A rule is data (name, technique, mitre id, severity, patterns).  The catalogue is
configuration of bounded size; it travels to executors inside the query plan.
"""
from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Rule:
    name: str
    technique_id: str
    mitre_id: str
    severity: int
    patterns: tuple[str, ...]
    description: str = ""
    tags: tuple[str, ...] = field(default_factory=tuple)


# Name, technique, mitre id, severity and regular expressions of every
# built-in rule, in evaluation order.
_BUILTIN = [
    ("amsi_bypass_reflection", "AMSI_BYPASS_REFLECT", "T1562.001", 90, [
        r'amsiInitFailed', r'AmsiScanBuffer', r'amsiContext',
        r'\[Ref\]\.Assembly\.GetType\s*\(\s*[\'"]System\.Management\.Automation\.',
        r'GetField\s*\(\s*[\'"]amsi', r'amsi\.dll']),
    ("amsi_bypass_com", "AMSI_BYPASS_COM", "T1562.001", 90, [
        r'IAmsiStream', r'amsi\.AMSI', r'AmsiInitialize', r'AmsiOpenSession']),
    ("download_cradle_webclient", "DOWNLOAD_CRADLE_WC", "T1105", 75, [
        r'Net\.WebClient', r'DownloadString\s*\(', r'DownloadFile\s*\(', r'DownloadData\s*\(',
        r'OpenRead\s*\(\s*[\'"]https?://']),
    ("download_cradle_bits", "DOWNLOAD_CRADLE_BITS", "T1197", 70, [
        r'Start-BitsTransfer', r'Import-Module\s+BitsTransfer']),
    ("download_cradle_invoke_webrequest", "DOWNLOAD_CRADLE_IWR", "T1105", 65, [
        r'Invoke-WebRequest\s+.*-Uri\s+[\'"]https?://', r'\bcurl\b.*https?://', r'wget\s+https?://']),
    ("reflective_pe_injection", "REFLECTIVE_INJECT", "T1055.001", 95, [
        r'Invoke-ReflectivePEInjection', r'Invoke-ReflectiveDllInjection',
        r'VirtualAlloc.*WriteProcessMemory', r'NtAllocateVirtualMemory']),
    ("shellcode_via_marshal", "SHELLCODE_MARSHAL", "T1055", 95, [
        r'Runtime\.InteropServices\.Marshal', r'AllocHGlobal\s*\(',
        r'GetDelegateForFunctionPointer\s*\(', r'UnsafeAddrOfPinnedArrayElement']),
    ("clm_bypass", "CLM_BYPASS", "T1059.001", 80, [
        r'__PSLockDownPolicy', r'LanguageMode.*FullLanguage', r'SessionState\.LanguageMode',
        r'RunspaceConfiguration', r'Add-Type\s+.*-Assembly\s+']),
    ("credential_harvest_mimikatz", "CRED_HARVEST", "T1003.001", 90, [
        r'sekurlsa', r'Invoke-Mimikatz', r'DumpCreds', r'privilege::debug', r'lsadump::',
        r'kerberos::', r'Get-Process\s+lsass']),
    ("wmi_persistence", "WMI_PERSIST", "T1546.003", 80, [
        r'Set-WmiInstance.*__EventFilter', r'ActiveScriptEventConsumer', r'__EventFilter',
        r'__FilterToConsumerBinding', r'CommandLineEventConsumer']),
    ("scheduled_task_creation", "SCHTASK_CREATE", "T1053.005", 55, [
        r'Register-ScheduledTask', r'New-ScheduledTaskAction', r'schtasks\s*/create',
        r'SchTasks\.exe.*\/create']),
    ("encoded_command", "ENCODED_CMD", "T1059.001", 50, [
        r'-EncodedCommand\s+[A-Za-z0-9+/]{20,}', r'(?:-enc|-e)\s+[A-Za-z0-9+/]{20,}',
        r'-ec\s+[A-Za-z0-9+/]{20,}']),
    ("etw_bypass", "ETW_BYPASS", "T1562.006", 80, [
        r'EtwEventWrite', r'ntdll.*EtwEventWrite', r'PatchEtw', r'EtwEventWriteFull']),
    ("defender_exclusion", "AV_EXCLUSION", "T1562.001", 75, [
        r'Add-MpPreference\s+-ExclusionPath', r'Add-MpPreference\s+-ExclusionExtension',
        r'Set-MpPreference\s+-DisableRealtimeMonitoring',
        r'Set-MpPreference\s+-DisableIOAVProtection', r'DisableAntiSpyware']),
    ("registry_run_persistence", "REG_PERSIST", "T1547.001", 55, [
        r'HKCU:\\Software\\Microsoft\\Windows\\CurrentVersion\\Run',
        r'HKLM:\\Software\\Microsoft\\Windows\\CurrentVersion\\Run', r'CurrentVersion\\Run']),
    ("reverse_shell_tcp", "REVERSE_SHELL", "T1059.001", 95, [
        r'Net\.Sockets\.TCPClient', r'System\.Net\.Sockets\.TcpClient',
        r'StreamReader.*StreamWriter.*while', r'\$stream\.Write\(', r'GetStream\(\).*StreamReader']),
    ("invoke_expression", "IEX_EXEC", "T1059.001", 40, [
        r'\bInvoke-Expression\b', r'\bIEX\s*\(', r'\bIEX\s+\$', r'\|\s*IEX\b']),
    ("execution_policy_bypass", "EXEC_POLICY_BYPASS", "T1059.001", 35, [
        r'-ExecutionPolicy\s+(?:Bypass|Unrestricted)', r'-ep\s+bypass',
        r'Set-ExecutionPolicy\s+(?:Bypass|Unrestricted)']),
    ("process_hollowing", "PROC_HOLLOW", "T1055.012", 90, [
        r'CreateProcess.*NtUnmapViewOfSection', r'ZwUnmapViewOfSection',
        r'WriteProcessMemory.*SetThreadContext', r'ResumeThread.*shellcode']),
    ("com_object_lateral", "COM_LATERAL", "T1021.003", 75, [
        r'New-Object\s+-ComObject\s+(?:WScript\.Shell|Shell\.Application)',
        r'\[activator\]::CreateInstance', r'MMC20\.Application', r'ShellWindows',
        r'ShellBrowserWindow']),
    ("cobalt_strike_indicators", "COBALT_STRIKE", "T1059.001", 90, [
        r'IEX\s*\(New-Object\s+Net\.WebClient\)\.DownloadString', r'from_base64_string.*gzip',
        r'IO\.Compression\.GzipStream', r'\$DoIt\s*=', r'func_get_proc_address',
        r'func_get_delegate_type']),
    ("amsi_bypass_patch", "AMSI_BYPASS_PATCH", "T1562.001", 95, [
        r'VirtualProtect.*amsi', r'WriteProcessMemory.*amsi', r'\[Byte\[\]\]\s*\(0xB8,\s*0x57',
        r'AmsiScanBuffer.*0x', r'kernel32.*VirtualProtect.*amsiInitFailed', r'Marshal\.Copy.*amsi']),
    ("amsi_force_disable", "AMSI_FORCE_DISABLE", "T1562.001", 85, [
        r'HKLM:\\SOFTWARE\\Microsoft\\Windows Script\\Settings.*AmsiEnable',
        r'Set-ItemProperty.*AmsiEnable.*0', r'reg\s+add.*AmsiEnable.*\/d\s+0',
        r'DisableAntiMalware', r'HKLM:.*ScriptScan.*Disable']),
    ("etw_patch_inline", "ETW_PATCH_INLINE", "T1562.006", 90, [
        r'ntdll.*EtwEventWrite', r'GetProcAddress.*EtwEventWrite', r'\[Byte\[\]\]\s*\(0xC3\)',
        r'VirtualProtect.*ntdll', r'Marshal\.Copy.*ntdll', r'EtwEventWriteTransfer']),
    ("etw_provider_disable", "ETW_PROVIDER_DISABLE", "T1562.006", 75, [
        r'AutoLogger-Diagtrack', r'reg\s+delete.*AutoLogger',
        r'Set-ItemProperty.*Start.*0x4.*AutoLogger', r'EventLog.*Set-Service.*Disabled',
        r'wevtutil\s+sl\s+.*\/e:false']),
    ("lolbin_certutil", "LOLBIN_CERTUTIL", "T1140", 75, [
        r'certutil\s+.*-decode', r'certutil\s+.*-decodehex',
        r'certutil\s+.*-urlcache\s+.*-split\s+.*-f', r'certutil\.exe.*-decode',
        r'certutil.*http[s]?://']),
    ("lolbin_mshta", "LOLBIN_MSHTA", "T1218.005", 80, [
        r'mshta\s+https?://', r'mshta\.exe\s+.*vbscript:', r'mshta\.exe\s+.*javascript:',
        r'Start-Process\s+mshta', r'shell\.run.*mshta']),
    ("lolbin_regsvr32", "LOLBIN_REGSVR32", "T1218.010", 80, [
        r'regsvr32\s+.*\/s\s+.*\/n\s+.*\/i:http', r'regsvr32\.exe.*scrobj\.dll',
        r'regsvr32\s+\/u\s+.*\/s\s+.*\/i:', r'Start-Process\s+regsvr32.*scrobj']),
    ("lolbin_rundll32", "LOLBIN_RUNDLL32", "T1218.011", 75, [
        r'rundll32\s+.*javascript:', r'rundll32\.exe\s+.*,\s*Control_RunDLL',
        r'rundll32\s+shell32\.dll,ShellExec_RunDLL',
        r'rundll32.*url\.dll.*FileProtocolHandler.*http', r'Start-Process\s+rundll32']),
    ("lolbin_bitsadmin", "LOLBIN_BITSADMIN", "T1197", 70, [
        r'bitsadmin\s+\/transfer', r'bitsadmin\s+\/addfile', r'bitsadmin\s+\/setnotifycmdline',
        r'bitsadmin\.exe.*http[s]?://']),
    ("wmic_remote_exec", "WMIC_REMOTE_EXEC", "T1047", 80, [
        r'wmic\s+\/node:', r'wmic\s+.*process\s+call\s+create', r'wmic\.exe.*\/node:.*call\s+create',
        r'Invoke-WmiMethod.*-ComputerName', r'Win32_Process.*Create.*ComputerName']),
    ("kerberoast_spn", "KERBEROAST_SPN", "T1558.003", 85, [
        r'GetRequest.*KerberosRequestorSecurityToken', r'Request-SPNTicket', r'Invoke-Kerberoast',
        r'[Ss]ystem\.IdentityModel\.Tokens\.KerberosRequestorSecurityToken', r'setspn\s+-[Tt]',
        r'Get-DomainSPNTicket']),
    ("asreproast", "ASREPROAST", "T1558.004", 85, [
        r'Invoke-ASREPRoast', r'Get-ASREPHash', r'DoesNotRequirePreAuth', r'DONT_REQ_PREAUTH',
        r'Get-DomainUser.*-PreauthNotRequired']),
    ("dpapi_decrypt", "DPAPI_DECRYPT", "T1555", 80, [
        r'dpapi::', r'Get-DPAPIMasterKey', r'Invoke-DPAPIDump', r'CryptUnprotectData',
        r'ProtectedData\.Unprotect', r'DPAPI.*MasterKey']),
    ("sam_dump", "SAM_DUMP", "T1003.002", 90, [
        r'reg\s+save.*HKLM\\SAM', r'reg\s+save.*HKLM\\SYSTEM', r'lsadump::sam', r'secretsdump',
        r'Invoke-NinjaCopy.*sam', r'shadow\s+copy.*sam', r'vssadmin.*create.*shadow']),
    ("dcsync_pattern", "DCSYNC_PATTERN", "T1003.006", 95, [
        r'lsadump::dcsync', r'Invoke-DCSync', r'DrsGetNCChanges', r'DS-Replication-Get-Changes',
        r'replicatechanges', r'drsuapi']),
    ("lsass_read", "LSASS_READ", "T1003.001", 90, [
        r'OpenProcess.*lsass', r'ReadProcessMemory.*lsass', r'MiniDumpWriteDump.*lsass',
        r'procdump.*lsass', r'comsvcs\.dll.*MiniDump', r'Out-Minidump', r'Invoke-Mimikatz.*lsass']),
    ("lateral_psremoting", "LATERAL_PSREMOTING", "T1021.006", 80, [
        r'Invoke-Command\s+.*-ComputerName', r'New-PSSession\s+.*-ComputerName',
        r'Enter-PSSession\s+.*-ComputerName', r'Invoke-Command\s+.*-Session\s+\$',
        r'New-CimSession\s+.*-ComputerName']),
    ("lateral_invoke_cmd", "LATERAL_INVOKE_CMD", "T1021.002", 75, [
        r'\\\\[^\\]+\\[Aa]dmin\$', r'\\\\[^\\]+\\C\$\\', r'psexec\s+\\\\', r'sc\s+\\\\.*create',
        r'net\s+use\s+\\\\']),
    ("lateral_wmi_exec", "LATERAL_WMI_EXEC", "T1021.003", 80, [
        r'Invoke-WMIMethod\s+.*-ComputerName', r'Get-WMIObject\s+.*-ComputerName',
        r'[Ww][Mm][Ii]\s+.*-ComputerName', r'Win32_Process\.Create.*namespace.*\\\\',
        r'\$wmi\s*=.*ConnectServer']),
    ("process_injection_openprocess", "PROC_INJECT_OPENPROC", "T1055", 90, [
        r'OpenProcess\s*\(', r'VirtualAllocEx\s*\(', r'WriteProcessMemory\s*\(',
        r'CreateRemoteThread\s*\(', r'QueueUserAPC\s*\(']),
    ("scheduled_task_hijack", "SCHTASK_HIJACK", "T1053.005", 75, [
        r'schtasks.*\/change.*\/TR', r'Set-ScheduledTask.*-Execute',
        r'[Ss]cheduled[Tt]ask.*\.Actions\.Add', r'SchTasks.*\/F.*\/SC']),
]


def builtin_rules() -> list[Rule]:
    return [Rule(n, t, m, s, tuple(p)) for n, t, m, s, p in _BUILTIN]


def load_rules(path: str | None = None, spark=None) -> list[Rule]:
    """Rules from a JSON file (a list, or an object with a ``rules`` list); the built-in
    catalogue when no file is given.  With a session the file is read by Spark, from any store it
    knows.  A named file that does not exist is an error."""
    if path is None:
        return builtin_rules()
    text = Path(path).read_text(encoding="utf-8") if spark is None else spark.read.text(path, wholetext=True).first()[0]
    data = json.loads(text)
    rows = data.get("rules", []) if isinstance(data, dict) else data
    return [
        Rule(r["name"], r["technique_id"], r["mitre_id"], int(r["severity"]),
             tuple(r["patterns"]), r.get("description", ""), tuple(r.get("tags", ())))
        for r in rows
    ]


def rules_table(spark, rules: list[Rule]):
    """The catalogue as a dimension DataFrame with one row per rule."""
    return spark.createDataFrame(
        [(i, r.name, r.technique_id, r.mitre_id, r.severity, list(r.patterns)) for i, r in enumerate(rules)],
        "rule_no int, rule_name string, technique_id string, mitre_id string, severity int, "
        "patterns array<string>",
    )
