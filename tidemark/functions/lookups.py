"""Code tables, word lists and vocabulary that appear in event text."""

from __future__ import annotations

# Event id -> name.
EVENT_NAMES: dict[int, str] = {
    1102: "Audit Log Cleared",
    4608: "Windows Starting Up",
    4616: "System Time Changed",
    4624: "Successful Logon",
    4625: "Failed Logon",
    4634: "Logoff",
    4647: "User Initiated Logoff",
    4648: "Explicit Credentials Logon",
    4649: "Replay Attack Detected",
    4656: "Object Handle Requested",
    4657: "Registry Value Modified",
    4660: "Object Deleted",
    4663: "Object Access Attempt",
    4670: "Object Permissions Changed",
    4672: "Special Privileges Assigned",
    4673: "Privileged Service Called",
    4674: "Privileged Object Operation",
    4688: "Process Created",
    4689: "Process Exited",
    4697: "Service Installed",
    4698: "Scheduled Task Created",
    4699: "Scheduled Task Deleted",
    4700: "Scheduled Task Enabled",
    4701: "Scheduled Task Disabled",
    4702: "Scheduled Task Updated",
    4719: "Audit Policy Changed",
    4902: "Per-User Audit Policy Created",
    4904: "Security Event Source Added",
    4905: "Security Event Source Removed",
    4907: "Auditing Settings Changed",
    4720: "User Account Created",
    4722: "User Account Enabled",
    4723: "Password Change Attempt",
    4724: "Password Reset",
    4725: "User Account Disabled",
    4726: "User Account Deleted",
    4728: "Added to Global Group",
    4729: "Removed from Global Group",
    4732: "Added to Local Group",
    4733: "Removed from Local Group",
    4738: "User Account Changed",
    4740: "Account Locked Out",
    4741: "Computer Account Created",
    4743: "Computer Account Deleted",
    4756: "Added to Universal Group",
    4764: "Group Type Changed",
    4767: "Account Unlocked",
    4781: "Account Name Changed",
    4798: "Local Group Membership Enumerated",
    4799: "Global Group Membership Enumerated",
    4768: "Kerberos TGT Requested",
    4769: "Kerberos Service Ticket Requested",
    4770: "Kerberos Service Ticket Renewed",
    4771: "Kerberos Pre-Auth Failed",
    4776: "NTLM Auth Attempt",
    4778: "Session Reconnected",
    4779: "Session Disconnected",
    4800: "Workstation Locked",
    4801: "Workstation Unlocked",
    4802: "Screensaver Invoked",
    4803: "Screensaver Dismissed",
    5140: "Network Share Accessed",
    5142: "Network Share Added",
    5143: "Network Share Modified",
    5144: "Network Share Deleted",
    5145: "Network Share Object Access Check",
    5025: "Firewall Service Stopped",
    5152: "Packet Blocked",
    5154: "Listen Permitted",
    5155: "Listen Blocked",
    5156: "Connection Allowed",
    5157: "Connection Blocked",
    5158: "Bind Permitted",
    5159: "Bind Blocked",
    12: "System Started",
    13: "System Shutdown",
    41: "Unexpected Reboot",
    46: "Time Service Sync",
    7000: "Service Failed to Start",
    7001: "Service Start Dependency Failed",
    7009: "Service Start Timeout",
    7011: "Service Operation Timeout",
    7022: "Service Hung on Start",
    7023: "Service Terminated (Error)",
    7024: "Service Terminated (Specific Error)",
    7026: "Boot Driver Failed to Load",
    7031: "Service Terminated Unexpectedly",
    7032: "Service Recovery Action Taken",
    7034: "Service Crashed",
    7035: "Service Control Request",
    7036: "Service State Changed",
    7040: "Service Start Type Changed",
    7045: "New Service Installed",
    400: "PowerShell Engine Started",
    403: "PowerShell Engine Stopped",
    600: "PowerShell Provider Started",
    4103: "PowerShell Module Logging",
    4104: "PowerShell Script Block Logged",
    100: "Task Started",
    101: "Task Start Failed",
    102: "Task Completed",
    103: "Task Action Failed to Start",
    106: "Task Registered",
    107: "Task Triggered on Time",
    108: "Task Triggered on Event",
    109: "Task Triggered by Registration",
    110: "Task Triggered on System Start",
    111: "Task Triggered on Logon",
    119: "Task Queued",
    129: "Task Action Started",
    140: "Task Updated",
    141: "Task Deleted",
    142: "Task Disabled",
    200: "Task Action Started",
    201: "Task Action Completed",
    203: "Task Action Failed",
    5857: "WMI Provider Loaded",
    5858: "WMI Query Error",
    5859: "WMI Event Filter Activated",
    5860: "WMI Permanent Subscription Registered",
    5861: "WMI Active Script Consumer",
    1000: "Application Error",
    1001: "Windows Error Reporting",
    1002: "Application Hang",
    1026: ".NET Runtime Error",
    1006: "Malware Scan Started",
    1007: "Malware Action Taken",
    1008: "Malware Action Failed",
    1009: "Malware Quarantine Restored",
    1013: "Malware History Deleted",
    1116: "Malware Detected",
    1117: "Malware Action Taken",
    1118: "Malware Remediation Failed",
    1119: "Malware Remediation Success",
    257: "AppX Deployment Started",
    258: "AppX Deployment Completed",
    260: "AppX Deployment Failed",
    263: "AppX Removal Started",
    4000: "Group Policy Processing Started",
    4001: "Group Policy Processing Completed",
    5312: "Group Policy Settings Applied",
    5313: "Group Policy Settings Not Applied",
}

# Well-known security ids.
KNOWN_SIDS: dict[str, str] = {
    "S-1-0-0": "Null Authority",
    "S-1-1-0": "Everyone",
    "S-1-2-0": "Local",
    "S-1-3-0": "Creator Owner",
    "S-1-3-1": "Creator Group",
    "S-1-5-1": "Dialup",
    "S-1-5-2": "Network",
    "S-1-5-3": "Batch",
    "S-1-5-4": "Interactive",
    "S-1-5-6": "Service",
    "S-1-5-7": "Anonymous",
    "S-1-5-9": "Enterprise Domain Controllers",
    "S-1-5-10": "Principal Self",
    "S-1-5-11": "Authenticated Users",
    "S-1-5-12": "Restricted Code",
    "S-1-5-13": "Terminal Server Users",
    "S-1-5-14": "Remote Interactive Logon",
    "S-1-5-15": "This Organization",
    "S-1-5-17": "IUSR",
    "S-1-5-18": "SYSTEM",
    "S-1-5-19": "LOCAL SERVICE",
    "S-1-5-20": "NETWORK SERVICE",
    "S-1-5-32-544": "Administrators",
    "S-1-5-32-545": "Users",
    "S-1-5-32-546": "Guests",
    "S-1-5-32-547": "Power Users",
    "S-1-5-32-548": "Account Operators",
    "S-1-5-32-549": "Server Operators",
    "S-1-5-32-550": "Print Operators",
    "S-1-5-32-551": "Backup Operators",
    "S-1-5-32-552": "Replicators",
    "S-1-5-32-555": "Remote Desktop Users",
    "S-1-5-32-556": "Network Configuration Operators",
    "S-1-5-32-558": "Performance Monitor Users",
    "S-1-5-32-559": "Performance Log Users",
    "S-1-5-32-568": "IIS_IUSRS",
    "S-1-5-32-580": "Remote Management Users",
}

# Change-journal reason bits in display order.
USN_REASONS: list[tuple[int, str]] = [
    (0x00000100, "FILE_CREATE"),
    (0x00000200, "FILE_DELETE"),
    (0x00000001, "DATA_OVERWRITE"),
    (0x00000002, "DATA_EXTEND"),
    (0x00000004, "DATA_TRUNCATION"),
    (0x00001000, "RENAME_OLD"),
    (0x00002000, "RENAME_NEW"),
    (0x00000800, "SECURITY_CHANGE"),
    (0x00008000, "BASIC_INFO_CHANGE"),
    (0x80000000, "CLOSE"),
]

# Small code tables.
LOGON_TYPES = {2: "Interactive", 3: "Network", 4: "Batch", 5: "Service", 7: "Unlock",
               8: "NetworkCleartext", 9: "NewCredentials", 10: "RemoteInteractive",
               11: "CachedInteractive"}
DRIVE_TYPES = {2: "Removable", 3: "Fixed", 4: "Network", 5: "CDROM", 6: "RAMDisk"}
INTERFACE_TYPES = {6: "Ethernet", 23: "PPP", 71: "WiFi", 131: "VPN"}
PCA_STATUSES = {0: "Install failure", 1: "Driver/kernel block", 2: "Abnormal exit",
                3: "PCA resolver invoked", 4: "Unset"}
ACTIVITY_TYPES = {5: "App Focus", 6: "Clipboard", 11: "User Engaged", 12: "Copy/Paste",
                  15: "User Activity", 16: "Background Activity"}
LEVEL_TAGS = {1: " [CRITICAL]", 2: " [ERROR]", 3: " [WARNING]"}
MACB_LABELS = {"M": "Last Written", "A": "Last Accessed", "C": "Last Changed (MFT)", "B": "Created"}
HIVE_ROOTS = {
    "SYSTEM": "HKLM\\SYSTEM",
    "SOFTWARE": "HKLM\\SOFTWARE",
    "SAM": "HKLM\\SAM",
    "SECURITY": "HKLM\\SECURITY",
    "NTUSER.DAT": "HKCU",
    "USRCLASS.DAT": "HKCU\\Software\\Classes",
}

# Words and fragments that never carry event content.
CHANNEL_WORDS = [
    "Security", "System", "Application", "Setup", "ForwardedEvents",
    "Windows", "System32", "SysWOW64", "Microsoft",
    "soft", "osoft", "rosoft", "Type", "Cryp", "Crypt",
]
PROVIDER_PREFIXES = ["Microsoft-", "PowerShell", "Windows PowerShell"]
PROVIDER_FRAGMENTS = ["Security-Auditing", "-Windows-Security", "icrosoft-", "-Windows-", "AUTHORITY"]
FIELD_LABELS = [
    "Provider", "EventID", "Version", "Level", "Task", "Opcode",
    "Keywords", "TimeCreated", "SystemTime", "EventRecordID",
    "Correlation", "ActivityID", "RelatedActivityID",
    "Execution", "ProcessID", "ThreadID", "Channel", "Computer",
    "EventData", "BinaryData", "UserData", "RenderingInfo",
    "SubjectUserSid", "SubjectUserName", "SubjectDomainName", "SubjectLogonId",
    "TargetUserSid", "TargetUserName", "TargetDomainName", "TargetLogonId",
    "TargetOutboundUserName", "TargetOutboundDomainName",
    "LogonType", "LogonProcessName", "AuthenticationPackageName", "LogonGuid",
    "WorkstationName", "IpAddress", "IpPort", "TransmittedServices",
    "LmPackageName", "KeyLength", "ImpersonationLevel", "VirtualAccount",
    "LinkedLogonId", "ElevatedToken", "TokenElevationType", "MandatoryLabel",
    "CallerProcessId", "CallerProcessName", "ProcessName", "ProcessPath",
    "ObjectServer", "ObjectType", "ObjectName", "HandleId", "ResourceAttributes",
    "ServiceName", "ServiceFileName", "ServiceType", "ServiceStartType",
    "ServiceAccount", "TaskName", "TaskContent", "TaskContentNew",
    "AccountName", "AccountDomain", "OldAccountName", "NewAccountName",
    "GroupName", "GroupSid", "GroupType", "SidHistory",
    "UserSid", "UserName", "DomainName", "Qualifiers",
    "PackageName", "TokenType", "PrivilegeList", "ShareName", "ShareLocalPath",
    "Application", "Direction", "SourceAddress", "SourcePort",
    "DestAddress", "DestPort", "Protocol",
    "QueryName", "QueryType", "QueryResults", "QueryStatus",
    "ScriptBlockText", "ScriptBlockId", "MessageNumber", "MessageTotal",
    "Path", "Param1", "Param2", "Param3", "Param4", "Param5",
    "Param6", "Param7", "Param8",
    "Name", "Guid", "Value",
    "TargetLogonGuid", "SubjectLogonGuid",
    "DeviceVersionMajor", "DeviceVersionMinor",
    "OperationTime", "OperationTime_msecs",
    "ErrorCode", "ResultCode", "StatusCode",
    "hc_stateid", "TaskId",
    "TargetVolumeGuid", "VolumeGuid",
    "RuleId", "RuleName", "FilterId",
    "TargetServerName", "TargetInfo", "TargetDomainSid",
    "TargetLinkedLogonId", "SubjectLinkedLogonId",
    "FailureReason", "SubStatus", "FailedApplication",
    "RestrictedAdminMode", "RemoteCredentialGuard",
    "AuditPolicyChanges",
    "CategoryId", "SubcategoryId", "SubcategoryGuid",
]

# Logon-record strings that are not account names.
NOT_ACCOUNTS = [
    "SYSTEM", "-", "NT AUTHORITY", "ANONYMOUS LOGON",
    "LOCAL SERVICE", "NETWORK SERVICE", "Window Manager", "Font Driver Host",
    "WORKGROUP", "NULL SID", "Everyone",
    "DWM-1", "DWM-2", "DWM-3", "DWM-4", "DWM-5",
    "UMFD-0", "UMFD-1", "UMFD-2", "UMFD-3", "UMFD-4",
    "Advapi", "User32", "Schannel", "NtLmSsp",
    "MICROSOFT_AUTHENTICATION_PACKAGE_V1_0",
    "Kerberos", "Negotiate", "NTLM",
    "RestrictedAdminMode", "RemoteCredentialGuard",
    "Security", "System", "Application", "localhost", "::1",
    "%%1842", "%%1843", "%%1844",
]

# Upper-case words that are not computer names.
NOT_COMPUTERS = [
    "SYSTEM", "WORKGROUP", "localhost", "Everyone",
    "ANONYMOUS", "NULL", "None", "builtin",
    "Negotiate", "Kerberos", "NTLM", "Advapi",
    "WS-Management", "Font", "AUTHORITY", "NETWORK",
    "DWM-1", "DWM-2", "DWM-3", "DWM-4", "DWM-5",
    "UMFD-0", "UMFD-1", "UMFD-2", "UMFD-3", "UMFD-4",
    "LOCAL", "SERVICE", "Window", "Manager",
    "LOCAL-SERVICE", "NETWORK-SERVICE",
]

# CP-1252 characters for the bytes 0x80..0x9F that differ from ISO-8859-1.
CP1252_BYTES = ("\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e"
                "\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f")
CP1252_CHARS = ("€‚ƒ„…†‡ˆ‰Š‹ŒŽ"
                "‘’“”•–—˜™š›œžŸ")
CP1252_UNDEFINED = "\x81\x8d\x8f\x90\x9d"
