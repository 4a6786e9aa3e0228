"""Values that results depend on."""

# Defaults of the flow and dataset parameters.
RANDOM_SEED = 1
PACKET_LIMIT = 20
CLASS_FLOOR = 50
CLASS_CAP = 20000
IDLE_TIMEOUT_S = 60
ACTIVE_TIMEOUT_ONLINE_S = 60
ACTIVE_TIMEOUT_OFFLINE_S = 10**6
MAX_SEQUENCE = 128
CODEBOOK_SIZE = 16384
MAX_PACKET_SIZE = 1500
SIZE_TOKEN_RANGE = 5000
LABEL_IGNORE_ID = -100
NO_PACKET = -1
SMOOTHING = 1e-6
INFINITE_WEIGHT = 1e7
MARKOV_CLUSTER_LIMIT = 200
KDE_POINTS = 100
TARGET_CLASS = "target_class"
CLIENT = "client_"
SERVER = "server_"

# Special tokens in id order.
SPECIAL_TOKENS = ("[EOF]", "[PAD]", "[UNK]", "[BOF]")

# Label rules.
COMMON_PROTOCOLS = ("DNS", "NTP", "STUN")
GARBAGE_PROTOCOLS = ("ICMP", "ICMPV6", "DHCPV6", "DHCP", "Unknown", "IGMP", "SSDP")
GARBAGE_APPLICATIONS = GARBAGE_PROTOCOLS + ("Amazon",)

# Named sets of file-name patterns to leave out.
FILE_PATTERNS = {
    "mawi": ("202004",),
    "mawi_unswnb_iscxvpn": ("raw_csv", "202004"),
    "iot_home": ("electronics", "camera", "2020", "environment", "healthcare", "home", "hub", "light", "trigger"),
    "mawi_iot_home": (
        "electronics", "camera", "2020", "environment", "healthcare", "home", "hub", "light", "trigger", "202004",
    ),
}

# Networks whose inner traffic is left out.
DEVICE_LAN = "192.168.1.0/24"
HOME_LAN = "192.168.88.0/24"

# Device table (mac, name, category).
DEVICES = (
    ("d0:52:a8:00:67:5e", "Smart Things", "hub"),
    ("44:65:0d:56:cc:d3", "Amazon Echo", "hub"),
    ("70:ee:50:18:34:43", "Netatmo Welcome", "camera"),
    ("f4:f2:6d:93:51:f1", "TP-Link Day Night Cloud camera", "camera"),
    ("00:16:6c:ab:6b:88", "Samsung SmartCam", "camera"),
    ("30:8c:fb:2f:e4:b2", "Dropcam", "camera"),
    ("00:62:6e:51:27:2e", "Insteon (wired)", "camera"),
    ("e8:ab:fa:19:de:4f", "Insteon (wireless)", "camera"),
    ("00:24:e4:11:18:a8", "Withings Smart Baby Monitor", "camera"),
    ("ec:1a:59:79:f4:89", "Belkin Wemo", "trigger"),
    ("ec:1a:59:83:28:11", "Belkin Wemo Motion sensor", "trigger"),
    ("50:c7:bf:00:56:39", "TP-Link Smart Plug", "trigger"),
    ("74:c6:3b:29:d7:1d", "iHome", "trigger"),
    ("18:b4:30:25:be:e4", "NEST Protect smoke alarm", "environment"),
    ("70:ee:50:03:b8:ac", "Netatmo weather station", "environment"),
    ("00:24:e4:1b:6f:96", "Withings Smart scale", "healthcare"),
    ("00:24:e4:20:28:c6", "Withings Aura smart sleep sensor", "healthcare"),
    ("74:6a:89:00:2e:25", "Blipcare Blood Pressure meter", "healthcare"),
    ("d0:73:d5:01:83:08", "LiFX Smart Bulb", "light_bulb"),
    ("18:b7:9e:02:20:44", "Triby Speaker", "electronics"),
    ("e0:76:d0:33:bb:85", "PIX-STAR photo-frame", "electronics"),
    ("70:5a:0f:e4:9b:c0", "HP Printer", "electronics"),
)
DEVICE_CATEGORIES = tuple(sorted({category for _, _, category in DEVICES}))

# IP protocol names by number; 138 is followed by 139.
UNKNOWN_PROTOCOL = "UNKNOWN"
IP_PROTOCOLS = {
    1: "ICMP", 2: "IGMP", 3: "GGP", 4: "IP-in-IP", 5: "ST", 6: "TCP", 7: "CBT", 8: "EGP", 9: "IGP",
    10: "BBN-RCC-MON", 11: "NVP-II", 12: "PUP", 13: "ARGUS", 14: "EMCON", 15: "XNET", 16: "CHAOS", 17: "UDP",
    18: "MUX", 19: "DCN-MEAS", 20: "HMP", 21: "PRM", 22: "XNS-IDP", 23: "TRUNK-1", 24: "TRUNK-2", 25: "LEAF-1",
    26: "LEAF-2", 27: "RDP", 28: "IRTP", 29: "ISO-TP4", 30: "NETBLT", 31: "MFE-NSP", 32: "MERIT-INP",
    33: "DCCP", 34: "3PC", 35: "IDPR", 36: "XTP", 37: "DDP", 38: "IDPR-CMTP", 39: "TP++", 40: "IL",
    41: "IPv6", 42: "SDRP", 43: "IPv6-Route", 44: "IPv6-Frag", 45: "IDRP", 46: "RSVP", 47: "GREs", 48: "DSR",
    49: "BNA", 50: "ESP", 51: "AH", 52: "I-NLSP", 53: "SwIPe", 54: "NARP", 55: "MOBILE", 56: "TLSP",
    57: "SKIP", 58: "IPv6-ICMP", 59: "IPv6-NoNxt", 60: "IPv6-Opts", 61: "Any host internal proto", 62: "CFTP",
    63: "Any local network", 64: "SAT-EXPAK", 65: "KRYPTOLAN", 66: "RVD", 67: "IPPC",
    68: "Any distributed file system", 69: "SAT-MON", 70: "VISA", 71: "IPCU", 72: "CPNX", 73: "CPHB", 74: "WSN",
    75: "PVP", 76: "BR-SAT-MON", 77: "SUN-ND", 78: "WB-MON", 79: "WB-EXPAK", 80: "ISO-IP", 81: "VMTP",
    82: "SECURE-VMTP", 83: "VINES", 84: "TTP |IPTM", 85: "NSFNET-IGP", 86: "DGP", 87: "TCF", 88: "EIGRP",
    89: "OSPF", 90: "Sprite-RPC", 91: "LARP", 92: "MTP", 93: "AX.25", 94: "OS", 95: "MICP", 96: "SCC-SP",
    97: "ETHERIP", 98: "ENCAP", 99: "Any private encryption scheme", 100: "GMTP", 101: "IFMP", 102: "PNNI",
    103: "PIM", 104: "ARIS", 105: "SCPS", 106: "QNX", 107: "A/N", 108: "IPComp", 109: "SNP",
    110: "Compaq-Peer", 111: "IPX-in-IP", 112: "VRRP", 113: "PGM", 114: "Any 0-hop protocol", 115: "L2TP",
    116: "DDX", 117: "IATP", 118: "STP", 119: "SRP", 120: "UTI", 121: "SMP", 122: "SM", 123: "PTP",
    124: "IS-IS over IPv4", 125: "FIRE", 126: "CRTP", 127: "CRUDP", 128: "SSCOPMCE", 129: "IPLT", 130: "SPS",
    131: "PIPE", 132: "SCTP", 133: "FC", 134: "RSVP-E2E-IGNORE", 135: "Mobility Header", 136: "UDPLite",
    137: "MPLS-in-IP", 138: "manet", 139: "HIP", 140: "Shim6", 141: "WESP", 142: "ROHC", 143: "Ethernet",
}
