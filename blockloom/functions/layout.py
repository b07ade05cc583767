"""On-disk layouts of the ext2/3/4 family as data: (field, byte offset, width) and flag masks.

Fixed values of the public on-disk format. Widths are bytes of a little-endian unsigned integer; ``raw`` fields are bytes.
"""

from __future__ import annotations

MAGIC = 0xEF53
EXTENT_MAGIC = 0xF30A
ROOT_INODE = 2

SUPERBLOCK = (
    ("s_inodes_count", 0x00, 4), ("s_blocks_count_lo", 0x04, 4), ("s_r_blocks_count_lo", 0x08, 4), ("s_free_blocks_count_lo", 0x0C, 4),
    ("s_free_inodes_count", 0x10, 4), ("s_first_data_block", 0x14, 4), ("s_log_block_size", 0x18, 4), ("s_log_cluster_size", 0x1C, 4),
    ("s_blocks_per_group", 0x20, 4), ("s_clusters_per_group", 0x24, 4), ("s_inodes_per_group", 0x28, 4), ("s_mtime", 0x2C, 4), ("s_wtime", 0x30, 4),
    ("s_mnt_count", 0x34, 2), ("s_max_mnt_count", 0x36, 2), ("s_magic", 0x38, 2), ("s_state", 0x3A, 2), ("s_errors", 0x3C, 2), ("s_minor_rev_level", 0x3E, 2),
    ("s_lastcheck", 0x40, 4), ("s_checkinterval", 0x44, 4), ("s_creator_os", 0x48, 4), ("s_rev_level", 0x4C, 4), ("s_def_resuid", 0x50, 2), ("s_def_resgid", 0x52, 2),
    ("s_first_ino", 0x54, 4), ("s_inode_size", 0x58, 2), ("s_block_group_nr", 0x5A, 2), ("s_feature_compat", 0x5C, 4), ("s_feature_incompat", 0x60, 4),
    ("s_feature_ro_compat", 0x64, 4), ("s_algorithm_usage_bitmap", 0xC8, 4), ("s_prealloc_blocks", 0xCC, 1), ("s_prealloc_dir_blocks", 0xCD, 1),
    ("s_reserved_gdt_blocks", 0xCE, 2), ("s_journal_inum", 0xE0, 4), ("s_journal_dev", 0xE4, 4), ("s_last_orphan", 0xE8, 4), ("s_def_hash_version", 0xFC, 1),
    ("s_jnl_backup_type", 0xFD, 1), ("s_desc_size", 0xFE, 2), ("s_default_mount_opts", 0x100, 4), ("s_first_meta_bg", 0x104, 4), ("s_mkfs_time", 0x108, 4),
    ("s_blocks_count_hi", 0x150, 4), ("s_r_blocks_count_hi", 0x154, 4), ("s_free_blocks_count_hi", 0x158, 4), ("s_min_extra_isize", 0x15C, 2),
    ("s_want_extra_isize", 0x15E, 2), ("s_flags", 0x160, 4), ("s_raid_stride", 0x164, 2), ("s_mmp_interval", 0x166, 2), ("s_mmp_block", 0x168, 8),
    ("s_raid_stripe_width", 0x170, 4), ("s_log_groups_per_flex", 0x174, 1), ("s_checksum_type", 0x175, 1), ("s_reserved_pad", 0x176, 2), ("s_kbytes_written", 0x178, 8),
    ("s_snapshot_inum", 0x180, 4), ("s_snapshot_id", 0x184, 4), ("s_snapshot_r_blocks_count", 0x188, 8), ("s_snapshot_list", 0x190, 4), ("s_error_count", 0x194, 4),
    ("s_first_error_time", 0x198, 4), ("s_first_error_ino", 0x19C, 4), ("s_first_error_block", 0x1A0, 8), ("s_first_error_line", 0x1C8, 4),
    ("s_last_error_time", 0x1CC, 4), ("s_last_error_ino", 0x1D0, 4), ("s_last_error_line", 0x1D4, 4), ("s_last_error_block", 0x1D8, 8),
    ("s_usr_quota_inum", 0x240, 4), ("s_grp_quota_inum", 0x244, 4), ("s_overhead_blocks", 0x248, 4), ("s_lpf_ino", 0x268, 4), ("s_prj_quota_inum", 0x26C, 4),
    ("s_checksum_seed", 0x270, 4), ("s_checksum", 0x3FC, 4),
)
SUPERBLOCK_RAW = (
    ("s_uuid", 0x68, 16), ("s_volume_name", 0x78, 16), ("s_last_mounted", 0x88, 64), ("s_journal_uuid", 0xD0, 16), ("s_first_error_func", 0x1A8, 32),
    ("s_last_error_func", 0x1E0, 32), ("s_mount_opts", 0x200, 64), ("s_encrypt_pw_salt", 0x258, 16),
)
SUPERBLOCK_ARRAYS = (("s_hash_seed", 0xEC, 4, 4), ("s_jnl_blocks", 0x10C, 4, 17), ("s_backup_bgs", 0x24C, 4, 2), ("s_encrypt_algos", 0x254, 1, 4))

COMPAT = {
    0x1: "DIR_PREALLOC", 0x2: "IMAGIC_INODES", 0x4: "HAS_JOURNAL", 0x8: "EXT_ATTR", 0x10: "RESIZE_INODE", 0x20: "DIR_INDEX", 0x40: "LAZY_BG", 0x80: "EXCLUDE_INODE",
    0x100: "EXCLUDE_BITMAP", 0x200: "SPARSE_SUPER2",
}
INCOMPAT = {
    0x1: "COMPRESSION", 0x2: "FILETYPE", 0x4: "RECOVER", 0x8: "JOURNAL_DEV", 0x10: "META_BG", 0x40: "EXTENTS", 0x80: "64BITS", 0x100: "MMP", 0x200: "FLEX_BG",
    0x400: "EA_INODE", 0x1000: "DIRDATA", 0x2000: "CSUM_SEED", 0x4000: "LARGEDIR", 0x8000: "INLINE_DATA", 0x10000: "ENCRYPT",
}
RO_COMPAT = {
    0x1: "SPARSE_SUPER", 0x2: "LARGE_FILE", 0x4: "BTREE_DIR", 0x8: "HUGE_FILE", 0x10: "GDT_CSUM", 0x20: "DIR_NLINK", 0x40: "EXTRA_ISIZE", 0x80: "HAS_SNAPSHOT",
    0x100: "QUOTA", 0x200: "BIGALLOC", 0x400: "METADATA_CSUM", 0x800: "REPLICA", 0x1000: "READONLY", 0x2000: "PROJECT",
}
GROUP_FLAGS = {0x1: "inode_uninit", 0x2: "block_uninit", 0x4: "inode_zeroed"}

#: (friendly name, low offset, width, high offset in a 64-byte descriptor or None)
GROUP = (
    ("bitmap_block", 0x00, 4, 0x20), ("bitmap_inode", 0x04, 4, 0x24), ("table_inode", 0x08, 4, 0x28), ("free_blocks", 0x0C, 2, 0x2C), ("free_inodes", 0x0E, 2, 0x2E),
    ("used_dirs", 0x10, 2, 0x30), ("flags", 0x12, 2, None), ("exclude_bitmap", 0x14, 4, 0x34), ("block_csum", 0x18, 2, 0x38), ("inode_csum", 0x1A, 2, 0x3A),
    ("itable_unused", 0x1C, 2, 0x32), ("checksum", 0x1E, 2, None),
)

INODE = (
    ("i_mode", 0x00, 2), ("i_uid", 0x02, 2), ("i_size_lo", 0x04, 4), ("i_atime", 0x08, 4), ("i_ctime", 0x0C, 4), ("i_mtime", 0x10, 4), ("i_dtime", 0x14, 4), ("i_gid", 0x18, 2),
    ("i_links_count", 0x1A, 2), ("i_blocks_lo", 0x1C, 4), ("i_flags", 0x20, 4), ("union_osd1", 0x24, 4), ("i_generation", 0x64, 4), ("i_file_acl_lo", 0x68, 4),
    ("i_size_high", 0x6C, 4), ("i_obso_faddr", 0x70, 4), ("uid_high", 0x78, 2), ("gid_high", 0x7A, 2),
)
I_BLOCK = (0x28, 60)
INODE_FLAGS = {
    0x1: "SECRM", 0x2: "UNRM", 0x4: "COMPR", 0x8: "SYNC", 0x10: "IMMUTABLE", 0x20: "APPEND", 0x40: "NODUMP", 0x80: "NOATIME", 0x1000: "INDEX", 0x2000: "IMAGIC",
    0x4000: "JOURNAL_DATA", 0x8000: "NOTAIL", 0x10000: "DIRSYNC", 0x20000: "TOPDIR", 0x40000: "HUGE_FILE", 0x80000: "EXTENTS", 0x200000: "EA_INODE",
    0x400000: "EOFBLOCKS", 0x10000000: "INLINE_DATA",
}
MODE_TYPES = {0x1000: "fifo", 0x2000: "character_device", 0x4000: "directory", 0x6000: "block_device", 0x8000: "file", 0xA000: "symlink", 0xC000: "socket"}
DIRENT_TYPES = {0: "unknown", 1: "file", 2: "directory", 3: "character_device", 4: "block_device", 5: "fifo", 6: "socket", 7: "symlink"}
#: Who may do what: bit of the mode.
PERMISSIONS = {
    "other": {"execute": 0x1, "write": 0x2, "read": 0x4},
    "group": {"execute": 0x8, "write": 0x10, "read": 0x20},
    "user": {"execute": 0x40, "write": 0x80, "read": 0x100},
}
SPECIAL_BITS = {"sticky": 0x200, "setgid": 0x400, "setuid": 0x800}

#: The journal: big-endian; (field, byte offset, width) of its superblock, and kinds of blocks.
JOURNAL_MAGIC = 0xC03B3998
JOURNAL_KINDS = {1: "descriptor", 2: "commit", 3: "superblock", 4: "superblock", 5: "revoke"}
JOURNAL_SUPERBLOCK = (
    ("version", 0x04, 4), ("block_size", 0x0C, 4), ("length", 0x10, 4), ("first", 0x14, 4), ("sequence", 0x18, 4), ("start", 0x1C, 4), ("errno", 0x20, 4), ("features_compat", 0x24, 4),
    ("features_incompat", 0x28, 4), ("features_ro_compat", 0x2C, 4),
)
