"""Random chess games as a table function. Positions are strings of 64 squares from a8 to h1, '.' where empty."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = "rnbqkbnr" + "p" * 8 + "." * 32 + "P" * 8 + "RNBQKBNR"
NAMES = {"P": "Pawn", "N": "Knight", "B": "Bishop", "R": "Rook", "Q": "Queen", "K": "King"}
#: Fixed orders in which moves are listed, as (rows, columns): a seeded game picks by place in the list.
KNIGHT = ((-2, -1), (-2, 1), (-1, -2), (-1, 2), (1, -2), (1, 2), (2, -1), (2, 1))
ROOK = ((0, 1), (0, -1), (1, 0), (-1, 0))
BISHOP = ((1, 1), (1, -1), (-1, 1), (-1, -1))
KING = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


def _ray(at: int, dr: int, dc: int) -> tuple[int, ...]:
    out, (r, c) = [], divmod(at, 8)
    while 0 <= (r := r + dr) < 8 and 0 <= (c := c + dc) < 8:
        out.append(8 * r + c)
    return tuple(out)


_RAYS = {d: [_ray(s, *d) for s in range(64)] for d in (*ROOK, *BISHOP)}
_STEPS = {k: [tuple(8 * (s // 8 + a) + s % 8 + b for a, b in ds if 0 <= s // 8 + a < 8 and 0 <= s % 8 + b < 8) for s in range(64)] for k, ds in (("N", KNIGHT), ("K", KING))}
_SLIDES = {"R": ROOK, "B": BISHOP, "Q": ROOK + BISHOP}


def square(at: int) -> str:
    return "abcdefgh"[at % 8] + "87654321"[at // 8]


def place(name: str) -> int:
    """The square of a name such as e4."""
    if len(name) != 2 or name[0] not in "abcdefgh" or name[1] not in "12345678":
        raise ValueError(f"{name!r} is no square")
    return 8 * "87654321".index(name[1]) + "abcdefgh".index(name[0])


def drawn(board: str) -> str:
    """A position in lines of text, with the files above and below and the ranks at both sides; empty light squares are dots."""
    files = "    " + "  ".join("abcdefgh")
    cells = lambda r: "│".join(f"{p if p != '.' else '. '[(r + c) % 2]} " for c, p in enumerate(board[8 * r : 8 * r + 8]))
    rows = [f"{8 - r} ║{cells(r)}║ {8 - r}" for r in range(8)]
    between = "\n  ╠" + "══╪" * 7 + "══╣\n"
    return "\n".join([files, "  ╔" + "══╤" * 7 + "══╗", between.join(rows), "  ╚" + "══╧" * 7 + "══╝", files])


@dataclass(frozen=True)
class Position:
    board: str = START
    white: bool = True
    castling: str = "KQkq"
    passing: int = -1  # the square a pawn has just passed

    def _mine(self, p: str) -> bool:
        return p != "." and p.isupper() == self.white

    def attacked(self, at: int, by_white: bool, board: str | None = None) -> bool:
        b = board or self.board
        kind = str.upper if by_white else str.lower
        if any(b[s] == kind("N") for s in _STEPS["N"][at]) or any(b[s] == kind("K") for s in _STEPS["K"][at]):
            return True
        r, c = divmod(at, 8)
        from_row = r + (1 if by_white else -1)
        if 0 <= from_row < 8 and any(0 <= c + d < 8 and b[8 * from_row + c + d] == kind("P") for d in (-1, 1)):
            return True
        for piece, rays in (("R", ROOK), ("B", BISHOP)):
            for d in rays:
                hit = next((b[s] for s in _RAYS[d][at] if b[s] != "."), ".")
                if hit in (kind(piece), kind("Q")):
                    return True
        return False

    def in_check(self) -> bool:
        king = self.board.find("K" if self.white else "k")
        return king >= 0 and self.attacked(king, not self.white)

    def candidates(self) -> list[tuple[int, int]]:
        """(from, to) by square of origin, not yet tested for check."""
        out: list[tuple[int, int]] = []
        b = self.board
        for at, p in enumerate(b):
            if not self._mine(p):
                continue
            kind = p.upper()
            if kind == "P":
                step, home = (-8, 6) if self.white else (8, 1)
                ahead = at + step
                if 0 <= ahead < 64:
                    if b[ahead] == ".":
                        out.append((at, ahead))
                        if at // 8 == home and b[ahead + step] == ".":
                            out.append((at, ahead + step))
                    for d in (-1, 1):
                        if 0 <= at % 8 + d < 8:
                            to = ahead + d
                            if (b[to] != "." and not self._mine(b[to])) or (b[to] == "." and to == self.passing):
                                out.append((at, to))
            elif kind in _STEPS:
                out += [(at, to) for to in _STEPS[kind][at] if not self._mine(b[to])]
                if kind == "K":
                    out += self._castles(at)
            else:
                for d in _SLIDES[kind]:
                    for to in _RAYS[d][at]:
                        if not self._mine(b[to]):
                            out.append((at, to))
                        if b[to] != ".":
                            break
        return out

    def _castles(self, at: int) -> list[tuple[int, int]]:
        home = 60 if self.white else 4
        side = str.upper if self.white else str.lower
        if at != home:
            return []
        out = []
        if side("k") in self.castling and self.board[home + 1 : home + 3] == ".." and self.board[home + 3] == side("r"):
            out.append((home, home + 2))
        if side("q") in self.castling and self.board[home - 3 : home] == "..." and self.board[home - 4] == side("r"):
            out.append((home, home - 2))
        return out

    def _castling(self, move: tuple[int, int]) -> bool:
        return self.board[move[0]].upper() == "K" and abs(move[0] - move[1]) == 2

    def _passes(self, move: tuple[int, int]) -> bool:
        return self.board[move[0]].upper() == "P" and (move[0] - move[1]) % 8 != 0 and self.board[move[1]] == "."

    def _board_after(self, move: tuple[int, int]) -> str:
        a, z = move
        b = list(self.board)
        if self._passes(move):
            b[8 * (a // 8) + z % 8] = "."
        if self._castling(move):
            rook, to = (a + 3, a + 1) if z > a else (a - 4, a - 1)
            b[to], b[rook] = b[rook], "."
        b[z], b[a] = b[a], "."
        if b[z] in "Pp" and z // 8 in (0, 7):
            b[z] = "Q" if self.white else "q"
        return "".join(b)

    def legal(self) -> list[tuple[int, int]]:
        out = []
        for m in self.candidates():
            way = range(min(m), max(m) + 1) if self._castling(m) else ()
            if any(self.attacked(s, not self.white) for s in way):
                continue
            b = self._board_after(m)
            king = b.find("K" if self.white else "k")
            if king < 0 or not self.attacked(king, not self.white, b):
                out.append(m)
        return out

    def after(self, move: tuple[int, int]) -> Position:
        a, z = move
        p = self.board[a]
        gone = {60: "KQ", 4: "kq", 63: "K", 56: "Q", 7: "k", 0: "q"}
        rights = "".join(c for c in self.castling if not any(c in gone.get(s, "") for s in move))
        passing = (a + z) // 2 if p.upper() == "P" and abs(a - z) == 16 else -1
        return Position(self._board_after(move), not self.white, rights, passing)

    def notation(self, move: tuple[int, int]) -> str:
        a, z = move
        if self._castling(move):
            return "O-O" if z > a else "O-O-O"
        kind, takes = self.board[a].upper(), self.board[z] != "." or self._passes(move)
        if kind == "P":
            out = (square(a)[0] + "x" if takes else "") + square(z)
            return out + (" e.p." if self._passes(move) else "") + ("=Q" if z // 8 in (0, 7) else "")
        return kind + ("x" if takes else "") + square(z)


def perft(depth: int, position: Position = Position()) -> int:
    moves = position.legal()
    return len(moves) if depth == 1 else sum(perft(depth - 1, position.after(m)) for m in moves)


def perft_counts(spark: SparkSession, depth: int) -> DataFrame:
    """How many positions each depth up to depth reaches: of every first move the positions after it, counted in tasks of their own."""

    def count(batches):
        for batch in batches:
            yield batch.assign(nodes=[perft(int(d) - 1, Position().after(Position().legal()[int(m)])) if d > 1 else 1 for d, m in zip(batch["depth"], batch["move"])])

    jobs = spark.range(depth).selectExpr("cast(id + 1 as int) as depth").crossJoin(spark.range(len(Position().legal())).selectExpr("cast(id as int) as move"))  # twenty first moves
    dealt = jobs.repartition(2 * spark.sparkContext.defaultParallelism)
    return dealt.mapInPandas(count, "depth int, move int, nodes bigint").groupBy("depth").agg(F.sum("nodes").cast("int").alias("nodes"))


PLY = "ply int, move_no int, color string, src string, dst string, piece string, notation string, is_capture boolean, is_check boolean, board_after string, result string"


def plies(seed: int, limit: int):
    """The plies of a game of uniformly random legal moves; the result is on every ply, as a game's outcome."""
    if limit < 1:
        raise ValueError("a game needs a limit of one half-move at least")
    rng, at, out = random.Random(seed), Position(), []
    result = f"Move limit reached ({limit} half-moves) — Draw."
    while len(out) < limit:
        moves = at.legal()
        if not moves:
            result = f"CHECKMATE — {'Black' if at.white else 'White'} wins!" if at.in_check() else "STALEMATE — Draw!"
            break
        m = rng.choice(moves)
        then = at.after(m)
        check = then.in_check()
        out.append((len(out) + 1, len(out) // 2 + 1, "White" if at.white else "Black", square(m[0]), square(m[1]), NAMES[at.board[m[0]].upper()], at.notation(m) + "+" * check, at.board[m[1]] != "." or at._passes(m), check, then.board))
        at = then
    return [(*p, result) for p in out]


def games(spark: SparkSession, n: int, *, seed: int = 0, limit: int = 200) -> DataFrame:
    """A row for each ply of n games; game i is played from seed + i."""

    @F.udtf(returnType=PLY)
    class Game:
        def eval(self, seed: int, limit: int):
            yield from plies(seed, limit)

    spark.udtf.register("tallyloom_game", Game)
    ids = spark.range(n).select(F.col("id").alias("game_index"), (F.col("id") + seed).cast("int").alias("seed"))
    ids.createOrReplaceTempView("tallyloom_games")
    return spark.sql(f"select g.game_index, g.seed, p.* from tallyloom_games g, lateral tallyloom_game(g.seed, {int(limit)}) p")


def long_enough(seed: int, index: int, wanted: int, limit: int, attempts: int = 12) -> tuple[int, list[tuple]]:
    """The first of the attempts with wanted plies, else the longest, and its seed; attempt k is played from seed + index + k * 1_000_003."""
    best: tuple[int, list[tuple]] = (seed + index, [])
    for k in range(attempts):
        used = seed + index + k * 1_000_003
        game = plies(used, limit)
        if len(game) > len(best[1]):
            best = used, game
        if len(game) >= wanted:
            break
    return best


def long_games(spark: SparkSession, n: int, *, seed: int = 0, wanted: int, limit: int = 400, attempts: int = 12) -> DataFrame:
    """A row for each ply of n games with game_index and the seed that was played: of its attempts, the first game with wanted plies, else the longest."""

    @F.udtf(returnType=f"seed int, {PLY}")
    class LongGame:
        def eval(self, seed: int, index: int, wanted: int, limit: int, attempts: int):
            used, game = long_enough(seed, index, wanted, limit, attempts)
            yield from ((used, *p) for p in game)

    spark.udtf.register("tallyloom_long_game", LongGame)
    spark.range(0, n, 1, n).select(F.col("id").cast("int").alias("game_index")).createOrReplaceTempView("tallyloom_long_games")
    return spark.sql(f"select g.game_index, p.* from tallyloom_long_games g, lateral tallyloom_long_game({int(seed)}, g.game_index, {int(wanted)}, {int(limit)}, {int(attempts)}) p")


def transcripts(plies_: DataFrame) -> DataFrame:
    """Per game its compact moves in one line, in order; a game is bounded by its limit."""
    cell = F.concat_ws(" ", F.col("move_no").cast("string"), "color", "src", "dst")
    rows = plies_.groupBy("game_index").agg(F.sort_array(F.collect_list(F.struct("ply", cell.alias("cell")))).alias("x"), F.max("result").alias("result"))
    return rows.select("game_index", F.array_join(F.transform("x", lambda x: x["cell"]), "; ").alias("compact"), F.size("x").alias("n_half_moves"), "result")


def transcript_texts(shown: DataFrame, clips: DataFrame) -> DataFrame:
    """Per clip its compact line, its transcript in columns of fixed width, and its moves and boards in order.

    shown: sample_id and the plies of its clip; clips: sample_id, game_index, game_result, n_half_moves. A clip is bounded by its plan.
    """
    compact = F.concat_ws(" ", F.col("move_no").cast("string"), "color", "src", "dst")
    line = F.concat_ws("  ", F.rpad(F.col("move_no").cast("string"), 6, " "), F.rpad("color", 8, " "), F.rpad("src", 8, " "), "dst")
    rows = shown.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("ply", compact.alias("compact"), line.alias("line"), "src", "dst", "move_no", "board_after"))).alias("x"))
    both = rows.join(clips, "sample_id")
    of = lambda name: F.transform("x", lambda x: x[name])
    head = F.concat(F.lit("Game #"), F.col("game_index").cast("string"), F.lit(" — Move Transcription\n" + "=" * 46 + "\n\nMove    Turn      Source    Destination\n----    ----      ------    -----------\n"))
    tail = F.concat(F.lit("\n\nResult: "), "game_result", F.lit("\nTotal half-moves: "), F.col("n_half_moves").cast("string"), F.lit("\n"))
    return both.select("sample_id", F.array_join(of("compact"), "; ").alias("compact"), F.concat(head, F.array_join(of("line"), "\n"), tail).alias("transcript"), of("src").alias("_src"), of("dst").alias("_dst"), of("move_no").alias("_no"), of("board_after").alias("_boards"))
