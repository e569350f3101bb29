from cadence.cli import main

main()
