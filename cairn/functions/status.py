"""Status codes of namespace operations; a batch reports them a row at a time."""

# The codes of the file protocol.
OK, PERM, NOENT, IO, ACCES, EXIST, NOTDIR, ISDIR, INVAL, FBIG, ROFS = 0, 1, 2, 5, 13, 17, 20, 21, 22, 27, 30
NAMETOOLONG, NOTEMPTY, STALE, BADHANDLE, NOT_SYNC, BADCOOKIE, NOTSUPP, SERVERFAULT = 63, 66, 70, 10001, 10002, 10003, 10004, 10006
REG, DIR, LNK = 1, 2, 5
