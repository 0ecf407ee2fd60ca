"""Feature contracts and lookup tables.

FIXED VALUES below must equal the detector's training schema for the
scores to mean anything; they are data, stated in their natural order.
"""

from __future__ import annotations

# ---- FIXED VALUES: syscall feature contract (training header order) ----
# ``total_events`` first, then 124 per-syscall counters.
_SYSCALL_FEATURES_TEXT = """
evt_epoll_wait evt_switch evt_select evt_wait4 evt_times evt_accept evt_futex evt_getsockname
evt_fcntl evt_read evt_stat evt_openat evt_mmap evt_munmap evt_madvise evt_writev evt_write
evt_close evt_epoll_ctl evt_clone evt_set_robust_list evt_mprotect evt_sigaltstack
evt_rt_sigprocmask evt_gettid evt_nanosleep evt_getpid evt_tgkill evt_epoll_pwait
evt_signaldeliver evt_procexit evt_execve evt_brk evt_access evt_fstat evt_arch_prctl evt_getuid
evt_getgid evt_geteuid evt_getegid evt_sysinfo evt_rt_sigaction evt_uname evt_getcwd evt_getppid
evt_socket evt_connect evt_lseek evt_getpgrp evt_prlimit evt_getpeername evt_pipe evt_dup
evt_set_tid_address evt_statfs evt_exit_group evt_rt_sigreturn evt_fadvise64 evt_umask
evt_fchmodat evt_ioctl evt_newfstatat evt_unlinkat evt_shutdown evt_sched_yield evt_lstat
evt_lgetxattr evt_getxattr evt_getdents64 evt_poll evt_pselect6 evt_mkdir evt_readlink
evt_rename evt_chmod evt_unlink evt_symlink evt_getrandom evt_sendmmsg evt_recvfrom evt_exit
evt_setsockopt evt_getsockopt evt_sendto evt_link evt_chdir evt_setitimer evt_sched_getaffinity
evt_readlinkat evt_epoll_create1 evt_capget evt_getpgid evt_rt_sigsuspend evt_kill evt_alarm
evt_setgid evt_chown evt_getgroups evt_setgroups evt_setresgid evt_setresuid evt_prctl
evt_getresuid evt_getresgid evt_clock_gettime evt_bind evt_recvmsg evt_lchown evt_faccessat
evt_utimensat evt_fstatfs evt_fchdir evt_flistxattr evt_fgetxattr evt_fsetxattr evt_mremap
evt_setpgid evt_timer_create evt_timer_settime evt_setuid evt_mknod evt_mount evt_umount
evt_finit_module
"""
SYSCALL_CONTRACT: list[str] = ["total_events"] + _SYSCALL_FEATURES_TEXT.split()

# ---- FIXED VALUES: raw syscall name -> contract feature (153 entries) ----
SYSCALL_ALIASES: dict[str, str] = {
    "epoll_wait": "evt_epoll_wait", "switch": "evt_switch", "select": "evt_select",
    "wait4": "evt_wait4", "times": "evt_times", "accept": "evt_accept", "accept4": "evt_accept",
    "futex": "evt_futex", "getsockname": "evt_getsockname", "fcntl": "evt_fcntl",
    "read": "evt_read", "stat": "evt_stat", "openat": "evt_openat", "open": "evt_openat",
    "mmap": "evt_mmap", "mmap2": "evt_mmap", "munmap": "evt_munmap", "madvise": "evt_madvise",
    "writev": "evt_writev", "write": "evt_write", "close": "evt_close", "epoll_ctl": "evt_epoll_ctl",
    "clone": "evt_clone", "clone3": "evt_clone", "set_robust_list": "evt_set_robust_list",
    "mprotect": "evt_mprotect", "sigaltstack": "evt_sigaltstack", "rt_sigprocmask": "evt_rt_sigprocmask",
    "gettid": "evt_gettid", "nanosleep": "evt_nanosleep", "clock_nanosleep": "evt_nanosleep",
    "getpid": "evt_getpid", "tgkill": "evt_tgkill", "epoll_pwait": "evt_epoll_pwait",
    "signaldeliver": "evt_signaldeliver", "procexit": "evt_procexit", "execve": "evt_execve",
    "execveat": "evt_execve", "brk": "evt_brk", "access": "evt_access", "fstat": "evt_fstat",
    "fstat64": "evt_fstat", "arch_prctl": "evt_arch_prctl", "getuid": "evt_getuid",
    "getgid": "evt_getgid", "geteuid": "evt_geteuid", "getegid": "evt_getegid",
    "sysinfo": "evt_sysinfo", "rt_sigaction": "evt_rt_sigaction", "uname": "evt_uname",
    "getcwd": "evt_getcwd", "getppid": "evt_getppid", "socket": "evt_socket", "connect": "evt_connect",
    "lseek": "evt_lseek", "getpgrp": "evt_getpgrp", "prlimit64": "evt_prlimit", "prlimit": "evt_prlimit",
    "getpeername": "evt_getpeername", "pipe": "evt_pipe", "pipe2": "evt_pipe", "dup": "evt_dup",
    "dup2": "evt_dup", "dup3": "evt_dup", "set_tid_address": "evt_set_tid_address",
    "statfs": "evt_statfs", "exit_group": "evt_exit_group", "rt_sigreturn": "evt_rt_sigreturn",
    "fadvise64": "evt_fadvise64", "umask": "evt_umask", "fchmodat": "evt_fchmodat",
    "ioctl": "evt_ioctl", "newfstatat": "evt_newfstatat", "statx": "evt_newfstatat",
    "unlinkat": "evt_unlinkat", "shutdown": "evt_shutdown", "sched_yield": "evt_sched_yield",
    "lstat": "evt_lstat", "lgetxattr": "evt_lgetxattr", "getxattr": "evt_getxattr",
    "getdents64": "evt_getdents64", "getdents": "evt_getdents64", "poll": "evt_poll",
    "ppoll": "evt_poll", "pselect6": "evt_pselect6", "mkdir": "evt_mkdir", "mkdirat": "evt_mkdir",
    "readlink": "evt_readlink", "readlinkat": "evt_readlinkat", "rename": "evt_rename",
    "renameat": "evt_rename", "renameat2": "evt_rename", "chmod": "evt_chmod", "fchmod": "evt_chmod",
    "unlink": "evt_unlink", "symlink": "evt_symlink", "symlinkat": "evt_symlink",
    "getrandom": "evt_getrandom", "sendmmsg": "evt_sendmmsg", "recvfrom": "evt_recvfrom",
    "exit": "evt_exit", "setsockopt": "evt_setsockopt", "getsockopt": "evt_getsockopt",
    "sendto": "evt_sendto", "send": "evt_sendto", "link": "evt_link", "linkat": "evt_link",
    "chdir": "evt_chdir", "setitimer": "evt_setitimer", "sched_getaffinity": "evt_sched_getaffinity",
    "epoll_create1": "evt_epoll_create1", "epoll_create": "evt_epoll_create1", "capget": "evt_capget",
    "getpgid": "evt_getpgid", "rt_sigsuspend": "evt_rt_sigsuspend", "kill": "evt_kill",
    "alarm": "evt_alarm", "setgid": "evt_setgid", "chown": "evt_chown", "fchown": "evt_chown",
    "lchown": "evt_lchown", "getgroups": "evt_getgroups", "setgroups": "evt_setgroups",
    "setresgid": "evt_setresgid", "setresuid": "evt_setresuid", "prctl": "evt_prctl",
    "getresuid": "evt_getresuid", "getresgid": "evt_getresgid", "clock_gettime": "evt_clock_gettime",
    "bind": "evt_bind", "recvmsg": "evt_recvmsg", "recv": "evt_recvfrom", "faccessat": "evt_faccessat",
    "faccessat2": "evt_faccessat", "utimensat": "evt_utimensat", "fstatfs": "evt_fstatfs",
    "fchdir": "evt_fchdir", "flistxattr": "evt_flistxattr", "fgetxattr": "evt_fgetxattr",
    "fsetxattr": "evt_fsetxattr", "mremap": "evt_mremap", "setpgid": "evt_setpgid",
    "timer_create": "evt_timer_create", "timer_settime": "evt_timer_settime", "setuid": "evt_setuid",
    "mknod": "evt_mknod", "mknodat": "evt_mknod", "mount": "evt_mount", "umount": "evt_umount",
    "umount2": "evt_umount", "finit_module": "evt_finit_module", "sendfile": "evt_write",
    "recvmmsg": "evt_recvfrom",
}

# ---- FIXED VALUES: network flow feature contract (aligned header order) ----
NETWORK_CONTRACT: list[str] = [
    "dport", "pkts", "bytes", "seq", "dur", "mean", "stddev", "sum", "min", "max",
    "spkts", "dpkts", "sbytes", "dbytes", "rate", "srate", "drate",
    "proto_arp", "proto_icmp", "proto_ipv6-icmp", "proto_proto", "proto_tcp", "proto_udp",
]

# ---- FIXED VALUES: detection windows (seconds since container start) ----
WINDOWS: dict[str, int | None] = {"N3": 3, "N5": 5, "N10": 10, "N15": 15, "full": None}

# ---- FIXED VALUES: label column candidates, first match wins ----
LABEL_CANDIDATES: tuple[str, ...] = ("label", "label_bin", "true_label", "y")

# ---- FIXED VALUES: metadata columns dropped before training ----
METADATA_COLUMNS: tuple[str, ...] = ("id", "folder")

# ---- FIXED VALUES: strace call extraction (ASCII identifier right before "(") ----
# The leading group stands in for a Unicode word boundary so that Java and
# RE2 engines agree; group 2 is the call name.
CALL_PATTERN = r"(^|[^\p{L}\p{N}_])([A-Za-z_][A-Za-z0-9_]*)\("
CALL_GROUP = 2

# ---- FIXED VALUES: sysdig sentinel written when capture was unavailable ----
SYSDIG_SENTINEL = "SYSDIG_UNAVAILABLE"


def alias_rows() -> list[tuple[str, str]]:
    return list(SYSCALL_ALIASES.items())
